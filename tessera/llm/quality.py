"""Quality classifier: regularised quadratic discriminant analysis.

Document statistics (lengths, character classes, repetition), log- or
root-transformed, are modelled by one Gaussian a class. Class moments are summed
over every labelled row; each covariance is shrunk towards the pooled one and
towards a scaled identity; scores are differences of Mahalanobis log densities
computed with cached Cholesky factors, plus the log prior, through a tempered
logistic. The evidence of a text counts in proportion to words / (words + SHORT),
so that a handful of words is left near the prior.

Defined results: null or empty text has the statistics of zero words and gets a
score like any other; ids are integers, a null id is scored and never learned from;
a label row without a document or without a quality is passed over; several labels
of one id count as their mean, 1 from one half on; with one class only, every score
is that class; repeated rows score alike; a very long text has statistics of all of
its words; an empty table gives no rows, and without labels every score is one half;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import LOWER, blocks, row_bounds, utf8, word_hashes, words

FEATURES = (
    "bytes", "words", "word_length", "word_spread", "upper", "digit", "mark", "symbol", "pipe", "other_punctuation", "non_ascii",
    "lines", "line_length", "shouted", "symbol_words", "repeat_next", "distinct", "top_share", "short_words", "space", "ended",
)
SHORT = 60.0
#: Labelled documents learned from where the sample is bounded (16 bytes each are broadcast).
MOST_LABELS = 200_000
_CLASS = {name: np.zeros(256, np.float64) for name in ("upper", "lower", "digit", "mark", "symbol", "pipe", "other", "space", "line", "high")}
_CLASS["upper"][65:91] = _CLASS["lower"][97:123] = _CLASS["digit"][48:58] = _CLASS["high"][192:] = 1
_CLASS["mark"][list(b"!?")] = _CLASS["symbol"][list(b"*$%&#@^~=+<>")] = _CLASS["pipe"][list(b"|")] = _CLASS["line"][10] = 1
_CLASS["other"][list(b"\"'()-/:;[]_`{}\\")] = _CLASS["space"][list(b" \t\n\r\v\f")] = 1


def statistics(column: pa.Array) -> np.ndarray:
    """One transformed row of ``FEATURES`` a text."""
    data, off = utf8(column)
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)

    def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    of = {name: per_row(table[data], off) for name, table in _CLASS.items()}
    start, end, row = words(data, off)
    at = row_bounds(row, n)
    count = np.diff(at).astype(np.float64)
    length = (end - start).astype(np.float64)
    hashes = word_hashes(data, start, end)
    some = np.maximum(count, 1)
    mean = per_row(length, at) / some
    spread = np.sqrt(np.maximum(per_row(length * length, at) / some - mean * mean, 0))
    in_word = lambda name: np.add.reduceat(_CLASS[name][data], start)[: len(start)] if len(start) else np.zeros(0)  # noqa: E731  gaps hold white space, which is in none of these classes
    upper, lower = in_word("upper"), in_word("lower")
    shouted = per_row((upper >= 2) & (lower == 0), at)
    symbols = per_row(in_word("symbol") + in_word("mark") >= 2, at)
    same = np.zeros(len(start), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = per_row(new, at)
    top = np.zeros(n)
    first = np.flatnonzero(new)
    np.maximum.at(top, row[order][first], np.diff(np.append(first, len(order))).astype(np.float64))
    ended = per_row(np.isin(data[end - 1], list(b".!?")) if len(end) else np.zeros(0), at)
    letters = np.maximum(of["upper"] + of["lower"] + of["high"], 1)
    full = np.maximum(size, 1)
    root = lambda part, whole: np.sqrt(part / whole)
    out = [
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), root(of["upper"], letters), root(of["digit"], full), root(of["mark"], full), root(of["symbol"], full),
        root(of["pipe"], full), root(of["other"], full), root(of["high"], full), np.log1p(of["line"]), np.log1p(size / (of["line"] + 1)), root(shouted, some), root(symbols, some),
        root(per_row(same, at), some), np.log1p(distinct) - np.log1p(count), root(top, some), root(per_row(length <= 3, at), some), root(of["space"], full), root(ended, some),
    ]
    return np.stack(out, axis=1)


assert len(FEATURES) == 21 and LOWER[65] == 97


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, Cholesky factor of the covariance, log prior less half the log determinant."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray
    temper: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Tempered probability of class 1."""
        density = []
        for mean, factor, offset in zip(self.mean, self.factor, self.offset, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(offset - 0.5 * np.einsum("ij,ij->j", z, z))
        with np.errstate(invalid="ignore"):
            gap = np.nan_to_num((density[1] - density[0] - self.prior) / self.temper, nan=0.0, posinf=1e6, neginf=-1e6)
        count = np.expm1(x[:, 1])
        gap = self.prior + gap * count / (count + SHORT)
        return np.round(1 / (1 + np.exp(-np.clip(gap, -40, 40))), 9)


def solve(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, ridge: float = 1e-3, temper: float = 4.0) -> Discriminant:
    """Factors from class counts, sums and sums of outer products."""
    d = len(FEATURES)
    total = sum(n for n, _, _ in moments.values())
    centre = {c: (s / n if n else np.zeros(d)) for c, (n, s, _) in moments.items()}
    scatter = {c: (ss - n * np.outer(centre[c], centre[c]) if n else np.zeros((d, d))) for c, (n, _, ss) in moments.items()}
    pooled = sum(scatter.values()) / max(total - 2, 1)
    mean, factors, offset = [], [], []
    for c in (0, 1):
        n = moments[c][0]
        own = scatter[c] / max(n - 1, 1)
        a = 1.0 if n <= d else shrink
        cov = (1 - a) * own + a * pooled
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / d + 1e-6) * np.eye(d)
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        mean.append(centre[c])
        factors.append(factor)
        offset.append((np.log(n / total) if n else -np.inf) - np.log(np.diag(factor)).sum() if total else 0.0)
    prior = float(np.log((moments[1][0] + 1) / (moments[0][0] + 1)))
    return Discriminant(np.array(mean), np.array(factors), np.array(offset), temper, prior)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array of FEATURES) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            x = statistics(b.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def moments_of(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Counts, sums and outer-product sums by class over all rows of (y, x): one row a class and entry from each task, summed by Spark."""
    d = len(FEATURES)
    size = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for b in batches:
            if b.num_rows:
                y = b.column("y").to_numpy(zero_copy_only=False)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        yield pa.RecordBatch.from_pydict({"c": np.repeat(np.arange(2), size), "k": np.tile(np.arange(size), 2), "v": total.reshape(-1)})

    sums = np.zeros((2, size))
    for c, k, v in labelled.mapInArrow(run, "c long, k long, v double").groupBy("c", "k").agg(F.sum("v")).collect():
        sums[c, k] = v
    return {c: (sums[c, 0], sums[c, 1 : 1 + d], sums[c, 1 + d :].reshape(d, d)) for c in (0, 1)}


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of labels that aren't held out."""
    return labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from labelled rows of ``stats`` that aren't held out."""
    return solve(moments_of(stats.join(learnable(labels), "doc_id").select("y", "x")))


def fit_texts(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Discriminant:
    """Learn from the texts of at most ``most`` labelled documents (those of least id hash), without statistics of the others."""
    y = learnable(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            x = statistics(b.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("y"), flat], ["y", "x"])

    return solve(moments_of(rows.select("y", F.col("text").cast("string").alias("text")).mapInArrow(run, "y int, x array<double>")))


def score_statistics(stats: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": model.score(x)})

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_score(model: Discriminant, text: Column) -> Column:
    """Score of a text column, for filters that keep the row."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [model.score(statistics(b.column("text"))) for b in blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text")]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text.cast("string"))
