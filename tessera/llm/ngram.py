"""Interpolated modified Kneser-Ney bigram model.

Spark counts; workers score. The number of parts follows from the bytes of text.
A first pass names heavy contexts (a bounded list); their bigrams are dealt by the
pair, all others by the context. Each task packs
its distinct bigrams into one blob a range, so the shuffle moves few bytes a bigram; a reducer merges the
blobs of its range and writes the range's sorted hash arrays (bigram counts, and
a context's total with its numbers of successors seen once, twice and more). A
second, smaller shuffle gathers each word's count and number of distinct
predecessors. Scoring maps the arrays and looks up a block's distinct keys in
key order.

p(w | u) = max(c(u,w) - D(c(u,w)), 0) / c(u) + g(u) q(w)
q(w) = max(b(w) - E(b(w)), 0) / b + h / (V + 1)

with b(w) the distinct predecessors of w, V the training vocabulary, and the
three discounts of each level from its counts of counts. An unseen context
leaves q. Every text ends with one end token, and starts from a start context.

Words and pairs are known by 64-bit hashes, counts are 64 bits wide.

Defined results: null or empty text is the end token alone; ids are integers, a
null id counts as training; repeated rows count each time; a very long text is
counted and scored whole; with no training text every token has the uniform
probability; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashstore import HashStore, Stored, build, part_of, write_part
from tessera.llm.textkit import blocks, mix, row_bounds, utf8, word_hashes, words
from tessera.sources.scratch import Scratch

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bytes of text tokenised at once; a task folds that much into its distinct bigrams before it packs them.
BLOCK, HELD = 1 << 20, 1_000_000
#: Bytes of text whose bigrams share a part; one task merges and sorts a part.
PART_BYTES = 24 << 20


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end token a row, each token's predecessor, and row bounds."""
    start, end, row = words(data, off)
    rows = len(off) - 1
    at = row_bounds(row, rows)
    out = np.empty(len(start) + rows, np.uint64)
    bounds = at + np.arange(rows + 1)
    stops = bounds[1:] - 1
    inner = np.ones(len(out), bool)
    inner[stops] = False
    out[inner], out[stops] = word_hashes(data, start, end), END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[bounds[:-1]] = START
    return out, before, bounds


def is_in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def bigram_key(u: np.ndarray, w: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair's hash, and what its part goes by: the context (so its bigrams share a part), or the pair's hash for heavy contexts."""
    pair = mix(u * np.uint64(0x9E3779B97F4A7C15) + w)
    return pair, np.where(is_in(u, heavy), pair, u)


def _merge(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (u, w) in u order with summed counts."""
    if not len(u):
        return u, w, c
    order = np.lexsort((w, u))
    u, w, c = u[order], w[order], c[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return u[at], w[at], np.add.reduceat(c, at)


def _merge_keys(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def heavy_contexts(texts: DataFrame, parts: int) -> np.ndarray:
    """Contexts of at least 1 / (2 parts) of all tokens, as far as tasks see them; fewer than 2 parts + 1 by construction. Any list gives the same model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in blocks(batches, "text", BLOCK):
            w, u, _ = tokens(*utf8(b.column("text")))
            k, c = np.unique(u, return_counts=True)
            total += len(w)
            keys, counts = _merge_keys(np.concatenate([keys, k]), np.concatenate([counts, c]))
            keep = counts * (8 * parts) >= total
            keys, counts = keys[keep], counts[keep]
        yield pa.RecordBatch.from_pydict({"k": np.append(keys.view(np.int64), 0), "c": np.append(counts, total), "all": np.append(np.zeros(len(keys), bool), True)})

    seen = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k long, c long, all boolean").groupBy("all", "k").agg(F.sum("c").alias("c"))
    # The row of all tokens, then the most frequent contexts: no more than 2 parts of them can qualify.
    (_, _, total), *top = seen.orderBy(F.desc("all"), F.desc("c"), "k").limit(2 * parts + 1).collect() or [(True, 0, 0)]
    return np.sort(np.array([k for _, k, c in top if c * 2 * parts >= total], np.int64).view(np.uint64))


def pack(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Distinct contexts with run lengths, successors, and counts (compressed)."""
    at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    runs = np.diff(np.append(at, len(u))).astype(np.uint32)
    squeezed = zlib.compress(runs.tobytes() + c.astype(np.uint32).tobytes(), 1)
    return struct.pack("<qqq", len(at), len(u), len(squeezed)) + u[at].tobytes() + w.tobytes() + squeezed


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n, _ = struct.unpack_from("<qqq", blob)
    heads, w = np.frombuffer(blob, np.uint64, k, 24), np.frombuffer(blob, np.uint64, n, 24 + 8 * k)
    rest = np.frombuffer(zlib.decompress(blob[24 + 8 * (k + n) :]), np.uint32)
    return np.repeat(heads, rest[:k]), w, rest[k:].astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from numbers of entries seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))  # type: ignore[return-value]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals that every probability needs."""

    uri: str
    parts: int
    word: Stored | None
    tokens: int
    vocabulary: int
    bigrams: int
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    low_free: float
    heavy: np.ndarray
    heavy_sums: np.ndarray

    def stores(self) -> tuple[HashStore, HashStore, HashStore]:
        return (
            HashStore.opened(f"{self.uri}/bigram", self.parts, ("c",)),
            HashStore.opened(f"{self.uri}/context", self.parts, ("c", "n1", "n2", "n3")),
            self.word.open(),
        )

    def probabilities(self, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model probability and training count of each token after its predecessor."""
        bigram, context, word = self.stores()
        _, got = word.lookup(w)
        count, b = got["c"].astype(np.float64), got["b"].astype(np.float64)
        q = np.full(len(w), 1.0 / (self.vocabulary + 1))
        if self.bigrams:
            cut = np.array((0.0, *self.low))[np.minimum(b, 3).astype(int)]
            q = np.maximum(b - cut, 0) / self.bigrams + self.low_free * q
        _, found = context.lookup(u)
        at = np.stack([found[c] for c in ("c", "n1", "n2", "n3")], axis=1).astype(np.float64)
        hot = is_in(u, self.heavy)
        at[hot] = self.heavy_sums[np.searchsorted(self.heavy, u[hot])]
        _, pair = bigram.lookup(*bigram_key(u, w, self.heavy))
        c, total = pair["c"].astype(np.float64), at[:, 0]
        cut = np.array((0.0, *self.high))[np.minimum(c, 3).astype(int)]
        free = at[:, 1:] @ np.array(self.high)
        seen = total > 0
        some = np.where(seen, total, 1)
        return np.where(seen, np.maximum(c - cut, 0) / some + np.where(seen, free / some, 1) * q, q), count


def train(texts: DataFrame, scratch: Scratch) -> Model:
    """Count a model over column ``text`` of ``texts`` into the scratch folder."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    uri = scratch.path("model")
    heavy = heavy_contexts(texts, parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                u, w, c = _merge(*map(np.concatenate, zip(*held, strict=True)))
                part = part_of(bigram_key(u, w, heavy)[1], parts)
                order = np.argsort(part, kind="stable")
                u, w, c = u[order], w[order], c[order]
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
                yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "blob": pa.array([pack(*(x[cut[p] : cut[p + 1]] for x in (u, w, c))) for p in some], pa.binary())})
                held.clear()

        for b in blocks(batches, "text", BLOCK):
            w, u, _ = tokens(*utf8(b.column("text")))
            held.append(_merge(u, w, np.ones(len(w), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs in part order: one part's bigrams are in memory at a time."""
        now, held = -1, []

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            u, w, c = _merge(*map(np.concatenate, zip(*map(unpack, held), strict=True)))
            held.clear()
            at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            sums = {"c": np.add.reduceat(c, at), **{f"n{k}": np.add.reduceat((c == k if k < 3 else c > 2).astype(np.int64), at) for k in (1, 2, 3)}}
            hot = is_in(u[at], heavy)
            write_part(f"{uri}/context", now, u[at][~hot], {k: v[~hot] for k, v in sums.items()})
            write_part(f"{uri}/bigram", now, bigram_key(u, w, heavy)[0], {"c": c.astype(np.uint32) if c.max() < 1 << 32 else c})
            order = np.argsort(w, kind="stable")
            ws, cs = w[order], c[order]
            head = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]]))
            of_count = np.zeros((5, len(head)), np.int64)
            of_count[:, 0] = [int((c == k).sum()) for k in range(5)]
            yield pa.RecordBatch.from_pydict({"hot": np.zeros(len(head), bool), "w": ws[head].view(np.int64), "c": np.add.reduceat(cs, head), "b": np.diff(np.append(head, len(ws))).astype(np.int64), **{f"n{k}": of_count[k] for k in (1, 2, 3, 4)}})
            if hot.any():  # partial sums of heavy contexts, added up below
                none = np.zeros(int(hot.sum()), np.int64)
                yield pa.RecordBatch.from_pydict({"hot": np.ones(len(none), bool), "w": u[at][hot].view(np.int64), "c": sums["c"][hot], "b": none, **{f"n{k}": sums[f"n{k}"][hot] for k in (1, 2, 3)}, "n4": none})

        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if p != now:
                    yield from finish()
                    now = p
                held.append(blob)
        yield from finish()

    blobs = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part int, blob binary")
    dealt = blobs.repartition(parts, "part").sortWithinPartitions("part")
    seen = scratch.table(dealt.mapInArrow(reduce, "hot boolean, w long, c long, b long, n1 long, n2 long, n3 long, n4 long"), "words")
    found = seen.where("hot").groupBy("w").agg(*[F.sum(k) for k in ("c", "n1", "n2", "n3")]).collect()
    of = {np.int64(r[0]).view(np.uint64): r[1:] for r in found}
    heavy_sums = np.array([of.get(k, (0, 0, 0, 0)) for k in heavy], np.float64).reshape(-1, 4)
    seen = seen.where("not hot")
    vocabulary = scratch.table(seen.groupBy("w").agg(F.sum("c").alias("c"), F.sum("b").alias("b")), "vocabulary")
    high = seen.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    low = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), *[F.coalesce(F.sum((F.col("b") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    word = build(vocabulary, "w", f"{uri}/word")
    scratch.drop("words", "vocabulary")
    d_high, d_low = discounts(list(high)), discounts(list(low)[3:])
    more = low[1] - low[3] - low[4]
    free = (d_low[0] * low[3] + d_low[1] * low[4] + d_low[2] * more) / low[2] if low[2] else 1.0
    return Model(uri, parts, word, low[0], low[1], low[2], d_high, d_low, free, heavy, heavy_sums)


def held_out(doc_id: Column) -> Column:
    """Rows the model may not learn from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            w, u, bounds = tokens(*utf8(b.column("text")))
            p, c = model.probabilities(w, u)
            per_row = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every row has its end token
            n = np.diff(bounds)
            total = per_row(np.log10(p))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_tokens": n.astype(np.int64), "n_known": per_row((c > 0).astype(np.int64)),
                "train_tokens": np.full(len(n), model.tokens, np.int64), "base_score": per_row(np.log10((c + 1) / (model.tokens + model.vocabulary + 1))), "score": total, "perplexity": 10 ** (-total / n),
            })

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
