"""A stored index of character trigrams, and what it answers: containment, the name ladder, regular expressions.

Each row of a text table has a number; a gram's posting list is the sorted numbers
of the rows that hold it, cut into blocks of numbers, so the list of a gram that
every row holds is many bounded rows. Runs of one and two characters are grams too,
so short needles have lists. A needle is looked up by its rarest grams, whose lists
are intersected within a block from the shortest on; rows that are left are
compared with the needle itself, so results don't depend on the index.

A regular expression gives alternatives of literals that a matching line must hold
(``required``); one that has none, or that isn't understood, is matched with every
row.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

#: Row numbers of a block (a power of two), grams a needle is looked up by, characters whose lists a task makes at once.
BLOCK_BITS, RAREST, PIECE = 14, 3, 1 << 20
#: Alternatives and class members that an expression is written out to.
MOST_WAYS, MOST_LETTERS = 64, 8
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z alone: the case that a regular expression ignores."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def gram_codes(texts: list[str], breaks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Every run of one to three characters of the texts as one number (21 bits a character), and the text each is of. ``breaks``: no run crosses a line end."""
    joined = "".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    on = np.ones(len(c), bool)
    if breaks:
        on = c != ord("\n") + 1
    code, out, of = c << 42, [], []
    for k in range(3):
        if k:
            both = np.zeros(len(c), bool)
            if len(c) > k:
                both[:-k] = (row[k:] == row[:-k]) & (c[k:] != ord("\n") + 1 if breaks else True)
                code = code.copy()
                code[:-k] |= c[k:] << (42 - 21 * k)
            on = on & both
        out.append(code[on])
        of.append(row[on])
    return np.concatenate(out), np.concatenate(of)


def _needle(needle: str) -> list[int]:
    codes, _ = gram_codes([needle])
    return np.unique(codes[len(codes) - max(1, len(needle) - 2) :]).tolist()


def needle_grams(needle: Column) -> Column:
    """What a row must hold to contain a needle: its trigrams, or itself if it is shorter."""

    @F.pandas_udf("array<long>")
    def held(needles: pd.Series) -> pd.Series:
        return needles.map(lambda x: _needle(x) if x else None)

    return held(needle)


@dataclass(frozen=True)
class GramIndex:
    """Written tables: rows (rid, the caller's columns, text), postings (gram, block, ids), totals (gram, n)."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """(ask_id, rid) of the rows that hold the rarest grams of each row of ``asked`` (ask_id, grams)."""
        one = asked.select("ask_id", F.explode(F.array_distinct("grams")).alias("gram"))
        counted = one.join(self.totals(), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        place = F.row_number().over(Window.partitionBy("ask_id").orderBy("n", "gram"))
        # The rarest gram of a needle that can't be found has no list: the needle meets nothing.
        chosen = counted.withColumn("place", place).where(F.col("place") <= RAREST).withColumn("k", F.count("*").over(Window.partitionBy("ask_id")))
        met = chosen.select("ask_id", "gram", "k").join(self.postings(), "gram")
        lists = F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids")))
        both = met.groupBy("ask_id", "block").agg(lists.alias("lists"), F.first("k").alias("k")).where(F.size("lists") == F.col("k"))
        left = F.aggregate(F.slice("lists", 2, RAREST), F.get("lists", F.lit(0))["ids"], lambda have, x: F.array_intersect(have, x["ids"]))
        return both.select("ask_id", F.explode(left).alias("rid"))

    def containing(self, needles: DataFrame) -> DataFrame:
        """(ask_id, needle, the rows' columns, text) of the rows whose text contains each needle (ask_id, needle); an empty needle is in every row, a null one in none."""
        real = needles.where("needle <> ''")
        found = self.candidates(real.select("ask_id", needle_grams(F.col("needle")).alias("grams"))).join(self.rows(), "rid").join(real, "ask_id").where(F.col("text").contains(F.col("needle")))
        empty = needles.where("needle = ''")
        if not empty.isEmpty():
            found = found.unionByName(self.rows().where("text is not null").crossJoin(F.broadcast(empty)))
        return found.drop("rid")

    def matching(self, pattern: str) -> DataFrame:
        """Rows that may match a regular expression, to be matched line by line."""
        ways = required(pattern)
        if ways is None:
            return self.rows().drop("rid")
        held = [(i, sorted({g for literal in way for g in _needle(literal)})) for i, way in enumerate(ways)]
        found = self.candidates(self.spark.createDataFrame(held, "ask_id int, grams array<long>")).select("rid").distinct()
        return self.rows().join(found, "rid", "left_semi").drop("rid")


def build(rows: DataFrame, path: str, text: Column, by_line: bool = False) -> GramIndex:
    """Index ``rows`` by ``text`` under ``path``, a folder that all executors share; the rows' own columns may not be named rid or text. ``by_line``: grams don't cross line ends, and a long text is taken apart line by line."""
    spark = rows.sparkSession
    index = GramIndex(spark, path)
    rows.withColumn("text", text).withColumn("rid", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    bits = BLOCK_BITS

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of as many rows as PIECE characters fill."""
        for batch in batches:
            texts, rids = batch.column("text").to_pylist(), batch.column("rid").to_numpy()
            size = np.cumsum([len(t) for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(size // PIECE)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                code, row = gram_codes(texts[lo:hi], by_line)
                rid = rids[lo:hi][row]
                order = np.lexsort((rid, code))
                code, rid = code[order], rid[order]
                new = np.append(True, (code[1:] != code[:-1]) | (rid[1:] != rid[:-1])) if len(code) else np.zeros(0, bool)
                code, rid = code[new], rid[new]
                block = rid >> bits
                head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))) if len(code) else np.zeros(0, np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.append(head, len(rid)).astype(np.int32)), pa.array(rid))
                yield pa.RecordBatch.from_arrays([pa.array(code[head]), pa.array(block[head]), ids], names=["gram", "block", "ids"])

    pieces = index.rows().select("rid", "text").where("text <> ''").mapInArrow(post, "gram long, block long, ids array<long>")
    lists = pieces.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    lists.write.mode("overwrite").parquet(f"{path}/postings")
    index.postings().groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).write.mode("overwrite").parquet(f"{path}/totals")
    return index


def containing(rows: DataFrame, text: Column, needles: DataFrame, scratch: Scratch, name: str = "grams") -> DataFrame:
    """Pairs of ``GramIndex.containing`` over an index made for these rows."""
    return build(rows, scratch.path(name), text).containing(needles)


# -- regular expressions ----------------------------------------------------------------------------------------------

_BREAK = None


def required(pattern: str) -> list[list[str]] | None:
    """Literals (A to Z lowered) of which every match holds all of one alternative; None where nothing is certain.

    Read by Python's own parser. Where Java's syntax differs, Python refuses the
    expression, except for operations on classes, which are refused here.
    """
    if "&&" in pattern or re.search(r"\[[^\]]*\[", pattern):
        return None
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    out = []
    for way in _ways(parsed):
        runs = [""]
        for token in way:
            if token is _BREAK:
                runs.append("")
            else:
                runs[-1] += token
        literals = [r for r in runs if len(r) >= 3] or [r for r in runs if r]
        if not literals:
            return None
        out.append(literals)
    return out


def _ways(parsed) -> list[list]:  # noqa: ANN001
    """Alternatives of a parsed sequence: characters that follow each other, and breaks."""
    out: list[list] = [[]]
    for op, value in parsed:
        one = _one(str(op), value)
        if len(one) * len(out) > MOST_WAYS:
            one = [[_BREAK]]
        out = [a + b for a in out for b in one]
    return out


def _one(op: str, value) -> list[list]:  # noqa: ANN001
    if op == "LITERAL":
        return [[chr(value).translate(ASCII_LOWER)]]
    if op == "IN":
        letters: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                letters.add(chr(x).translate(ASCII_LOWER))
            elif str(kind) == "RANGE" and x[1] - x[0] < MOST_LETTERS:
                letters |= {chr(c).translate(ASCII_LOWER) for c in range(x[0], x[1] + 1)}
            else:
                return [[_BREAK]]
        return [[c] for c in sorted(letters)] if len(letters) <= MOST_LETTERS else [[_BREAK]]
    if op in ("AT", "ASSERT", "ASSERT_NOT"):  # of no width
        return [[]]
    if op == "SUBPATTERN":
        return _ways(value[-1])
    if op == "ATOMIC_GROUP":
        return _ways(value)
    if op == "BRANCH":
        found = [w for branch in value[1] for w in _ways(branch)]
        return found if len(found) <= MOST_WAYS else [[_BREAK]]
    if op.endswith("_REPEAT"):
        low, high, body = value
        inner = _ways(body)
        if not low:
            return [[], *inner] if high == 1 and len(inner) < MOST_WAYS else [[_BREAK]]
        out = [[]]
        for _ in range(min(low, 3)):
            out = [a + b for a in out for b in inner] if len(out) * len(inner) <= MOST_WAYS else [[*a, _BREAK] for a in out]
        return out if low == high and low <= 3 else [[*a, _BREAK] for a in out]
    return [[_BREAK]]
