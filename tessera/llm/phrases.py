"""Phrase collocations by contiguous pattern growth.

A first pass lists the words of each language with their counts, and the prefixes
that hold so much of the corpus that one task shouldn't have them all. A second
pass projects occurrences: a pointer is a word with the words that follow it in
its piece, and equal ones are counted before the shuffle. The pointers of a prefix
meet in one part; there its frequent extensions are grown to the right, depth
first, each on the slice of pointers that its prefix left. Pointers of a heavy
prefix are dealt by the next longer prefix instead, and its partial counts added
up. Scores, containment and ranks are joins and windows over the frequent phrases.

Words are known by 64-bit keys of (language, word). Keys that two words share are
found in the first pass and replaced, so equal keys are equal words.

Defined results: a null or empty text has no words; a null language is ``und``
(and the same as a text marked so); repeated rows count each time; very long
texts are counted whole; phrases of one score and count go by their UTF-8 bytes;
an empty table gives no rows; other columns are ignored. Counts up to 10^14.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashstore import part_of
from tessera.llm.textkit import LOWER, blocks, mix, release, utf8, word_hashes, words
from tessera.sources.scratch import Scratch

#: Bytes between words, and those of them that end a piece.
PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\v\f\r")] = True
GAP = PIECE_END.copy()
GAP[[32, 9]] = True
#: Bytes of text tokenised at once, occurrences that a task counts before it sends them (under 2^21, so that ranks fit), bytes of text whose occurrences share a part.
BLOCK, HELD, PART_BYTES = 1 << 20, 1 << 19, 8 << 20
#: Most Spark partitions of the projection; larger inputs have several parts in one, read one after the other.
MOST_PARTITIONS = 1 << 15
#: Heavy prefixes and words of shared keys that are sent to the tasks; the list of the former may be any, the latter are a few in 10^10 words.
MOST_HEAVY, MOST_SHARED = 1 << 20, 100_000
#: Slices of a language that are ranked apart before the last ranking.
SLICES = 256
STEP = np.uint64(0x9E3779B97F4A7C15)


def keys_of(word: np.ndarray, lang: np.ndarray, bits: int = 64) -> np.ndarray:
    """Key of a word of a language, from their hashes; 0 means no word."""
    return np.maximum(mix(word * STEP + lang) >> np.uint64(64 - bits), np.uint64(1))


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix with one more word."""
    return mix(prefix * STEP + word)


@dataclass(frozen=True)
class Words:
    """Words of a block: where they stand, their rows, whether the next word is in the same piece, languages, keys."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    goes_on: np.ndarray
    lang: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, block: pa.RecordBatch, bits: int = 64) -> Words:
        data, off = utf8(block.column("text"))
        start, end, row = words(data, off, GAP)
        piece = np.append(0, np.cumsum(PIECE_END[data]))[start]
        goes_on = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False) if len(row) else np.zeros(0, bool)
        name, cut = utf8(block.column("lang"))
        lang = word_hashes(name, cut[:-1], cut[1:], fold=False)[row]
        return cls(data, start, end, row, goes_on, lang, keys_of(word_hashes(data, start, end), lang, bits))

    def texts(self, at: np.ndarray) -> list[str]:
        raw = LOWER[self.data].tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def following(key: np.ndarray, goes_on: np.ndarray, longest: int) -> list[np.ndarray]:
    """Each word's key and the keys of the words behind it in its piece, up to ``longest`` in all; 0 where the piece ends."""
    out = [key]
    for _ in range(longest - 1):
        last = out[-1]
        out.append(np.where(goes_on, np.append(last[1:], np.uint64(0)), np.uint64(0)))
    # A word k places on is there only if all before it go on, which holds as each column is the former one shifted.
    return out


def counted(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns in order, with summed counts."""
    values, code = np.unique(columns[0], return_inverse=True)
    levels = [values]
    for c in columns[1:]:
        base, rank = np.unique(c, return_inverse=True)
        pairs, code = np.unique(code.astype(np.int64) << np.int64(32) | rank, return_inverse=True)
        levels = [x[pairs >> np.int64(32)] for x in levels] + [base[pairs & np.int64(0xFFFFFFFF)]]
    summed = np.zeros(len(levels[0]), np.int64)
    np.add.at(summed, code, counts)
    return levels, summed


def _small(x: np.ndarray) -> bytes:
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    raw = zlib.compress(x.tobytes(), 1)
    return struct.pack("<ccqq", x.dtype.kind.encode(), str(x.itemsize).encode(), len(x), len(raw)) + raw


def _unsmall(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    kind, size, _, length = struct.unpack_from("<ccqq", blob, at)
    at += 18
    return np.frombuffer(zlib.decompress(blob[at : at + length]), f"<{kind.decode()}{size.decode()}").astype(np.int64), at + length


def pack(columns: list[np.ndarray], lang: np.ndarray, counts: np.ndarray) -> bytes:
    """Ordered rows as a tree: each level's values, the numbers of rows below them, languages of the first level, counts of the last."""
    out, new = [], np.zeros(len(counts), bool)
    new[:1] = True
    for c in columns[:-1]:
        new = new | np.append(True, c[1:] != c[:-1])
        at = np.flatnonzero(new)
        if not out:
            out.append(_small_hashes(lang[at]))
        out += [_small(np.diff(np.append(at, len(c)))), c[at].tobytes()]
    return b"".join([*out, _small(counts), columns[-1].tobytes()])


def _small_hashes(x: np.ndarray) -> bytes:
    few, which = np.unique(x, return_inverse=True)
    return struct.pack("<q", len(few)) + few.tobytes() + _small(which)


def unpack(blob: bytes, longest: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    few, at = np.frombuffer(blob, np.uint64, n, 8), 8 + 8 * n
    which, at = _unsmall(blob, at)
    columns, lang = [], few[which]
    for level in range(longest):
        size, at = _unsmall(blob, at)
        value = np.frombuffer(blob, np.uint64, len(size), at)
        at += value.nbytes
        if level == longest - 1:
            return [*columns, value], lang, size
        columns.append(np.repeat(value, size))
        lang = np.repeat(lang, size) if not level else lang
    raise ValueError(longest)


def is_in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def route(columns: list[np.ndarray], heavy: np.ndarray) -> np.ndarray:
    """What an occurrence's part goes by: its shortest prefix that isn't heavy."""
    prefix = out = columns[0]
    on = np.ones(len(prefix), bool)
    for c in columns[1:]:
        on = on & is_in(prefix, heavy)
        if not on.any():
            break
        prefix = longer(prefix, c)
        out = np.where(on, prefix, out)
    return out


def grow(columns: list[np.ndarray], counts: np.ndarray, heavy: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequent phrases among ordered occurrences: a row that begins with each, its number of words, its count, and whether other parts have more of it."""
    total = np.append(0, np.cumsum(counts))
    heads, split, new, prefix = [], [], np.zeros(len(counts), bool), None
    for c in columns:
        new = new | np.append(True, c[1:] != c[:-1])
        prefix = c if prefix is None else longer(prefix, c)
        at = np.flatnonzero(new)
        heads.append(at)
        split.append(is_in(prefix[at], heavy))
    split[-1][:] = False
    found: list[tuple[int, int, int, bool]] = []

    def extend(level: int, lo: int, hi: int) -> None:
        """The frequent ways to go on from the prefix of ``level`` words that rows lo to hi share."""
        a, b = np.searchsorted(heads[level], (lo, hi))
        at = heads[level][a:b]
        stop = np.append(at[1:], hi)
        n, apart = total[stop] - total[at], split[level][a:b]
        chosen = np.flatnonzero(((n >= least) | apart) & (columns[level][at] != 0))
        for x, y, c, s in zip(at[chosen].tolist(), stop[chosen].tolist(), n[chosen].tolist(), apart[chosen].tolist(), strict=True):
            found.append((x, level + 1, c, s))
            if level + 1 < len(columns):
                extend(level + 1, x, y)

    if len(counts):
        extend(0, 0, len(counts))
    row, size, n, apart = zip(*found, strict=True) if found else ((), (), (), ())
    return np.array(row, np.int64), np.array(size, np.int64), np.array(n, np.int64), np.array(apart, bool)


@dataclass(frozen=True)
class Frequent:
    """Written tables: phrases (size, w1.., n, g for the language) and their words (key, lang, word), and the languages' totals."""

    phrases: DataFrame
    words: DataFrame
    totals: DataFrame


def frequent_phrases(texts: DataFrame, scratch: Scratch, longest: int = 3, least: int = 10, bits: int = 64) -> Frequent:
    """Contiguous phrases of up to ``longest`` words that a language's pieces hold at least ``least`` times. Keys have ``bits`` bits: any number gives the same phrases, as long as few words share a key."""
    spark = texts.sparkSession
    rows = texts.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    seen = scratch.table(_words_and_prefixes(rows, parts, longest, bits).groupBy("prefix", "key", "lang", "word").agg(F.sum("n").alias("n")), "seen")
    words_seen = seen.where("not prefix").select("key", "lang", "word", "n")
    totals = scratch.table(words_seen.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    heavy = _heavy(seen, totals, parts)
    shared = _shared(words_seen)
    listed = words_seen.where(F.col("n") >= least)
    if shared:
        renamed = spark.createDataFrame([(lang, word, new) for (lang, word), new in shared.items()], "lang string, word string, new long")
        listed = listed.join(F.broadcast(renamed), ["lang", "word"], "left").withColumn("key", F.coalesce("new", "key"))
    found = scratch.table(_project(rows, parts, longest, least, bits, heavy, shared), "grown")
    names = [f"w{i}" for i in range(1, longest + 1)]
    whole = found.where("not split").select("size", *names, "g", "n")
    added = found.where("split").groupBy("size", *names, "g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return Frequent(scratch.table(whole.unionByName(added), "phrases"), scratch.table(listed.select("key", "lang", "word"), "listed"), totals)


def _words_and_prefixes(rows: DataFrame, parts: int, longest: int, bits: int) -> DataFrame:
    """A block's words with counts; a task's prefixes of at least 1 / (8 parts) of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, many, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in blocks(batches, "text", BLOCK):
            w = Words.of(b, bits)
            if not len(w.key):
                continue
            first, which = _by_word(w)
            yield pa.RecordBatch.from_pydict({"prefix": np.zeros(len(first), bool), "key": w.key[first].view(np.int64), "lang": b.column("lang").take(pa.array(w.row[first])).cast("string"), "word": pa.array(w.texts(first), pa.string()), "n": np.bincount(which).astype(np.int64)})
            total += len(w.key)
            prefix, hashes = None, [prefixes]
            for c in following(w.key, w.goes_on, longest)[:-1]:
                prefix = c if prefix is None else longer(prefix, c)
                hashes.append(prefix[c != 0])
            (prefixes,), many = counted([np.concatenate(hashes)], np.concatenate([many, np.ones(sum(map(len, hashes[1:])), np.int64)]))
            keep = many * (8 * parts) >= total
            prefixes, many = prefixes[keep], many[keep]
        empty = pa.array([""] * len(prefixes), pa.string())
        yield pa.RecordBatch.from_pydict({"prefix": np.ones(len(prefixes), bool), "key": prefixes.view(np.int64), "lang": empty, "word": empty, "n": many})

    return rows.mapInArrow(run, "prefix boolean, key long, lang string, word string, n long")


def _by_word(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First places of a block's distinct (language, word), and the number of each word; words of one key are told apart by their bytes."""
    _, first, which = np.unique(w.key, return_index=True, return_inverse=True)
    length = w.end - w.start
    of = first[which]
    if (length == length[of]).all() and (w.lang == w.lang[of]).all():
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        low = LOWER[w.data]
        if (low[place + np.repeat(w.start[of], length)] == low[place + np.repeat(w.start, length)]).all():
            return first, which
    seen: dict[tuple, int] = {}
    which = np.array([seen.setdefault(x, len(seen)) for x in zip(w.lang.tolist(), w.texts(np.arange(len(w.key))), strict=True)])
    return np.unique(which, return_index=True)[1], which


def _heavy(seen: DataFrame, totals: DataFrame, parts: int) -> np.ndarray:
    """Prefixes with at least 1 / (2 parts) of all words, as far as tasks noted them; by construction no more than 2 parts of each length."""
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = seen.where(F.col("prefix") & (F.col("n") * (2 * parts) >= total)).orderBy(F.desc("n"), "key").select("key").limit(MOST_HEAVY).collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _shared(words_seen: DataFrame) -> dict[tuple[str, str], int]:
    """New keys of the words that share a key: some 0.03 pairs among 10^9 words."""
    twice = words_seen.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    found = words_seen.join(twice, "key").select("lang", "word").limit(MOST_SHARED + 1).collect()
    if len(found) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} words share their keys")
    salt = 0
    while found:
        salt += 1
        new = [int.from_bytes(hashlib.blake2b(f"{salt} {lang} {word}".encode(), digest_size=8).digest(), "little", signed=True) for lang, word in found]
        fresh = words_seen.sparkSession.createDataFrame([(k,) for k in new], "key long")
        if 0 not in new and len({*new}) == len(new) and words_seen.join(F.broadcast(fresh), "key", "left_semi").isEmpty():
            return {(lang, word): k for (lang, word), k in zip(found, new, strict=True)}
    return {}


def _project(rows: DataFrame, parts: int, longest: int, least: int, bits: int, heavy: np.ndarray, shared: dict[tuple[str, str], int]) -> DataFrame:
    """Occurrences dealt by prefix, and the frequent phrases grown from them."""

    def keys(w: Words, lang: pa.Array) -> np.ndarray:
        if not shared:
            return w.key
        of_row = lang.to_pylist()
        return np.array([shared.get((of_row[r], t), k) for r, t, k in zip(w.row.tolist(), w.texts(np.arange(len(w.key))), w.key.view(np.int64).tolist(), strict=True)], np.int64).view(np.uint64)

    def send(held: list[tuple[list[np.ndarray], np.ndarray]]) -> pa.RecordBatch:
        joined = [np.concatenate(x) for x in zip(*(c for c, _ in held), strict=True)]
        values, first = np.unique(joined[0], return_index=True)
        language = np.concatenate([g for _, g in held])[first]
        columns, n = counted(joined, np.ones(len(joined[0]), np.int64))
        lang = language[np.searchsorted(values, columns[0])]
        part = part_of(mix(route(columns, heavy)), parts)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
        blobs = []
        for p in some:
            at = order[cut[p] : cut[p + 1]]
            blobs.append(pack([c[at] for c in columns], lang[at], n[at]))
        return pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in blocks(batches, "text", BLOCK):
            w = Words.of(b, bits)
            held.append((following(keys(w, b.column("lang")), w.goes_on, longest), w.lang))
            size += len(w.key)
            if size > HELD:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)
        release()

    names = [f"w{i}" for i in range(1, longest + 1)]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One part's occurrences are in memory at a time."""
        now, blobs = -1, []

        def finish() -> Iterator[pa.RecordBatch]:
            if not blobs:
                return
            opened = [unpack(b, longest) for b in blobs]
            blobs.clear()
            joined = [np.concatenate(x) for x in zip(*(c for c, _, _ in opened), strict=True)]
            values, first = np.unique(joined[0], return_index=True)
            language = np.concatenate([g for _, g, _ in opened])[first]
            columns, n = counted(joined, np.concatenate([c for _, _, c in opened]))
            at, size, many, split = grow(columns, n, heavy, least)
            if len(at):
                word = {name: np.where(size > i, c[at], np.uint64(0)).view(np.int64) for i, (name, c) in enumerate(zip(names, columns, strict=True))}
                yield pa.RecordBatch.from_pydict({"split": split, "size": size.astype(np.int32), **word, "g": language[np.searchsorted(values, columns[0][at])].view(np.int64), "n": many})

        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if p != now:
                    yield from finish()
                    now = p
                blobs.append(blob)
        yield from finish()
        release()

    dealt = rows.mapInArrow(count, "part int, blob binary").repartition(min(parts, MOST_PARTITIONS), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(reduce, "split boolean, size int, " + ", ".join(f"{x} long" for x in names) + ", g long, n long")


def _exactly(c: Column) -> Column:
    return c.cast("decimal(14,0)")


def collocations(texts: DataFrame, scratch: Scratch, longest: int = 3, least: int = 10, top: int = 2000, bits: int = 64) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer candidate holds its words one behind the other and has at least half its count.
    """
    found = frequent_phrases(texts, scratch, longest, least, bits)
    names = [f"w{i}" for i in range(1, longest + 1)]
    candidates = found.phrases.where("size > 1")
    inside = []
    for size in range(3, longest + 1):
        for n in range(2, size):
            for first in range(size - n + 1):
                word = [F.col(names[first + i]) if i < n else F.lit(0).cast("long") for i in range(longest)]
                inside.append(candidates.where(F.col("size") == size).select(*[w.alias(x) for w, x in zip(word, names, strict=True)], F.col("n").alias("of_longer")))
    kept = candidates.withColumnRenamed("n", "a")
    if inside:
        union = inside[0]
        for more in inside[1:]:
            union = union.unionByName(more)
        most = union.groupBy(*names).agg(F.max("of_longer").alias("of_longer"))
        kept = kept.join(most, names, "left").where(F.coalesce(100 * F.col("of_longer") < 50 * F.col("a"), F.lit(True))).drop("of_longer")
    cuts, none = [], F.lit(0).cast("long")
    for k in range(1, longest):
        head = [F.col(names[i]) if i < k else none for i in range(longest - 1)]
        rest = [F.col(names[k + i]) if k + i < longest else none for i in range(longest - 1)]
        cuts.append(F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), *[h.alias(f"h{i}") for i, h in enumerate(head, 1)], *[t.alias(f"t{i}") for i, t in enumerate(rest, 1)])))
    cut = kept.select("*", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select(*kept.columns, "c.*")
    pieces = found.phrases.where(F.col("size") < longest)
    of = lambda letter, name: pieces.select(*[F.col(names[i - 1]).alias(f"{letter}{i}") for i in range(1, longest)], F.col("n").alias(name))
    cut = cut.join(of("h", "l"), [f"h{i}" for i in range(1, longest)]).join(of("t", "r"), [f"t{i}" for i in range(1, longest)])
    a, left, right = map(_exactly, (F.col("a"), F.col("l"), F.col("r")))
    # 37 and 28 digits: within Spark's decimals.
    cut = cut.withColumn("above", a * a * F.lit(1000000).cast("decimal(7,0)")).withColumn("below", left * right).withColumn("score", F.expr("above div below"))
    scored = cut.groupBy("size", *names, "g", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least")).select("size", *names, "g", "a", "least.score", "least.l", "least.r")
    scored = scratch.table(scored, "scored")
    order = [F.desc("score"), F.desc("a")]
    sliced = scored.select("g", "score", "a", F.pmod(F.xxhash64(*names), F.lit(SLICES)).alias("slice"))
    first = sliced.withColumn("place", F.row_number().over(Window.partitionBy("g", "slice").orderBy(*order))).where(F.col("place") <= top)
    last = first.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("place") <= top)
    bar = last.groupBy("g").agg(F.min(F.struct("score", "a")).alias("bar"))
    reached = scored.join(bar, "g").where(F.struct("score", "a") >= F.col("bar")).drop("bar")
    word = lambda i: found.words.select(F.col("key").alias(names[i]), *([F.col("lang")] if not i else []), F.col("word").alias(f"s{i + 1}"))
    reached = reached.join(word(0), names[0])
    for i in range(1, longest):
        reached = reached.join(word(i), names[i], "left")
    named = reached.withColumn("phrase", F.concat_ws(" ", *[f"s{i + 1}" for i in range(longest)]))
    final = [*order, F.asc("phrase")]
    sliced = named.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*final))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*final))).where(F.col("rank") <= top)
    return ranked.join(found.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), "score")
