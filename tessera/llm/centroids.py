"""Centroid clustering over integers, exact to the last unit.

Vectors become integers and are written once, packed. In each round tasks read
blocks of them and take squared distances as |x|^2 - 2 x.c + |c|^2 with one matrix
product a block, in float64 where magnitudes prove that every sum stays below
2^53, else in 64-bit integers where 2^63 suffices, else in unbounded ones. Sums and
counts of each cluster leave a task as one row and are combined by treeAggregate,
so the driver sees as many rows as there are centroids. Centroids that stay the
same end the rounds early: all further ones would leave them so.

Defined results: vectors that are null, have another number of components, or hold
a null, NaN or infinite one are left out; ids may be null (hashed as an empty text)
and may repeat, ties of the first choice go by the vector's packed bytes; with
fewer vectors than centroids there are fewer centroids, with none no rows; among
equal distances the smaller number wins; a cluster without vectors stays where it
is. A distance or inertia that doesn't fit a long is null, the clusters are right
all the same. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import utf8
from tessera.sources.scratch import Scratch

#: Vectors whose distances are taken at once.
BLOCK_ROWS = 8192
#: Bytes of a packed component: 32 bits, 64 bits, or as many as the largest double needs.
WIDTHS = (4, 8, 136)
LONG = 1 << 63


def whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64, or unbounded integers where those are too small. Scale is a power of two, so products are exact."""
    if np.abs(rows).max(initial=0.0) * scale < 2**62:
        return np.floor(rows * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in rows.ravel().tolist()]
    return np.array(exact, object).reshape(rows.shape)


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row's components as little-endian integers of the least width that holds them."""
    if rows.dtype == object:
        return [b"".join(int(x).to_bytes(WIDTHS[2], "little", signed=True) for x in row) if max(map(abs, row)) >= LONG // 2 else pack(np.array([row], np.int64))[0] for row in rows]
    small = np.abs(rows).max(axis=1, initial=0) < 1 << 31
    return [row.astype("<i4" if s else "<i8").tobytes() for row, s in zip(rows, small.tolist(), strict=True)]


def unpack(packed: pa.Array, size: int) -> np.ndarray:
    """Rows of packed vectors, all in the widest type that one of them needs."""
    data, off = utf8(packed)
    width = np.diff(off) // size
    if (width == WIDTHS[0]).all():
        return np.frombuffer(data.tobytes(), "<i4").reshape(-1, size).astype(np.int64)
    values = packed.to_pylist()
    if (width <= WIDTHS[1]).all():
        return np.stack([np.frombuffer(v, "<i4" if w == WIDTHS[0] else "<i8").astype(np.int64) for v, w in zip(values, width.tolist(), strict=True)])
    return np.array([[int.from_bytes(v[i * w : (i + 1) * w], "little", signed=True) for i in range(size)] for v, w in zip(values, width.tolist(), strict=True)], object)


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every row from every centroid, exact."""
    reach = int(abs(rows).max(initial=0)) + int(abs(centroids).max(initial=0))
    # Norms, products and twice the products are all at most size * reach^2, and so is the result.
    bound = rows.shape[1] * reach * reach
    if 2 * bound < 1 << 53:
        x, c = rows.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)).astype(np.int64)
    if 2 * bound < LONG and rows.dtype != object:
        x, c = rows, centroids.astype(np.int64)
    else:
        x, c = rows.astype(object), centroids.astype(object)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


@dataclass(frozen=True)
class Part:
    """Of each cluster: its vectors' number, componentwise sum, and sum of distances, in unbounded integers."""

    count: list[int]
    total: list[list[int]]
    inertia: list[int]

    def plus(self, other: Part) -> Part:
        return Part([a + b for a, b in zip(self.count, other.count, strict=True)], [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(self.total, other.total, strict=True)], [a + b for a, b in zip(self.inertia, other.inertia, strict=True)])


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with their vectors, nearest centroids and distances."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(lo, BLOCK_ROWS)
            rows = unpack(block.column("packed"), centroids.shape[1])
            far = distances(rows, centroids)
            near = np.argmin(far, axis=1) if far.dtype != object else np.array([min(range(len(d)), key=d.__getitem__) for d in far.tolist()])
            yield block, rows, near, far[np.arange(len(rows)), near]


def _sum(values: np.ndarray) -> list[int] | int:
    """Column sums in unbounded integers; 64-bit ones where they can't pass."""
    if values.dtype != object and len(values) * int(abs(values).max(initial=0)) >= LONG:
        values = values.astype(object)
    if values.ndim > 1:
        return values.sum(axis=0).tolist() if len(values) else [0] * values.shape[1]
    return int(values.sum())


def totals(vectors: DataFrame, centroids: np.ndarray) -> Part:
    """Counts, sums and inertia of the clusters around ``centroids``."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = zero
        for _, rows, near, far in assigned(batches, centroids):
            mine = [near == i for i in range(k)]
            part = part.plus(Part([int(m.sum()) for m in mine], [_sum(rows[m]) for m in mine], [_sum(far[m]) for m in mine]))
        # Numbers as text: they may be longer than any column type.
        yield pa.RecordBatch.from_pydict({"part": [json.dumps([part.count, part.total, part.inertia])]})

    zero = Part([0] * k, [[0] * size for _ in range(k)], [0] * k)
    parts = vectors.select("packed").mapInArrow(run, "part string").rdd
    return parts.treeAggregate(zero, lambda a, row: a.plus(Part(*json.loads(row[0]))), Part.plus, depth=3)


def packed_vectors(table: DataFrame, size: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and packed integers of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "packed": pa.array(pack(whole(rows, scale)), pa.binary())})

    v = F.col(embedding).cast("array<double>")
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == size) & finite)
    return kept.mapInArrow(run, "vec_id long, packed binary")


@dataclass(frozen=True)
class Clustering:
    """The packed vectors, the final centroids, and what belongs to them."""

    vectors: DataFrame
    centroids: np.ndarray
    part: Part

    def rows(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
        centroids, long = self.centroids, lambda x: x if x < LONG else None
        inertia = [long(x) for x in self.part.inertia]
        total = long(sum(self.part.inertia))
        digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, near, far in assigned(batches, centroids):
                yield pa.RecordBatch.from_pydict({
                    "vec_id": block.column("vec_id"), "cluster": near.astype(np.int32), "distance": pa.array([long(x) for x in far.tolist()], pa.int64()),
                    "cluster_inertia": pa.array([inertia[i] for i in near.tolist()], pa.int64()), "inertia": pa.array([total] * len(near), pa.int64()), "centroid_sha256": [digest[i] for i in near.tolist()],
                })

        return self.vectors.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def cluster(table: DataFrame, scratch: Scratch, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> Clustering:
    """Lloyd's rounds from the ``k`` vectors whose ids, hashed with the seed, come first."""
    vectors = scratch.table(packed_vectors(table, size, scale, vec_id, embedding), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(order, "packed").limit(k).select("packed").collect()
    if not first:
        return Clustering(vectors, np.zeros((0, size), np.int64), Part([], [], []))
    centroids = narrow(unpack(pa.array([bytes(r[0]) for r in first], pa.binary()), size).tolist())
    for _ in range(rounds):
        part = totals(vectors, centroids)
        new = [[s // n for s in total] if n else old for n, total, old in zip(part.count, part.total, centroids.tolist(), strict=True)]
        if new == centroids.tolist():
            return Clustering(vectors, centroids, part)
        centroids = narrow(new)
    return Clustering(vectors, centroids, totals(vectors, centroids))


def narrow(rows: Sequence[Sequence[int]]) -> np.ndarray:
    """int64 where all components fit, else unbounded integers."""
    return np.array(rows, np.int64 if all(abs(x) < LONG // 2 for row in rows for x in row) else object)
