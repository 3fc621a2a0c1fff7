import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import centroids
from tessera.sources.scratch import Scratch


def plain(rows, k, rounds, size, scale=1024, seed=3):
    """The contract, word by word, in unbounded integers."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), centroids.pack(centroids.narrow([r[1]]))[0]))
    c = [v for _, v in first[:k]]
    if not c:
        return []

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, x, strict=True)) for x in c]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        near = [nearest(v)[0] for _, v in kept]
        new = []
        for j, old in enumerate(c):
            mine = [v for (_, v), n in zip(kept, near, strict=True) if n == j]
            new.append([sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else old)
        c = new
    got = [(i, *nearest(v)) for i, v in kept]
    long = lambda x: x if x < 2**63 else None
    inertia = [sum(d for _, n, d in got if n == j) for j in range(len(c))]
    return sorted(((i, n, long(d), long(inertia[n]), long(sum(inertia)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in got), key=str)


def run(spark, rows, k=3, rounds=10, size=4, parts=3):
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, packed int, cluster string").repartition(parts)
    return sorted(map(tuple, centroids.cluster(table, Scratch(spark, "test"), k, rounds, size).rows().collect()), key=str)


def vectors(seed, n, size=4, reach=3.0):
    r = random.Random(seed)
    return [(i, [r.uniform(-reach, reach) for _ in range(size)]) for i in range(n)]


EDGE = [(None, [0.5] * 4), (None, [0.25] * 4), (1, [0.5] * 4), (1, [0.5] * 4), (1, [-0.5] * 4), (2, None), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 1.0, 1.0]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0]), (8, []), (9, [-0.0001, 0.0, 5e-324, -5e-324])]


@pytest.mark.parametrize(("seed", "n", "k", "rounds"), [(1, 200, 3, 10), (2, 50, 8, 2), (3, 5, 8, 4), (4, 120, 1, 3), (5, 60, 5, 0)])
def test_rounds_are_those_of_the_plain_rule(spark, seed, n, k, rounds):
    rows = vectors(seed, n) + EDGE
    assert run(spark, rows, k, rounds) == plain(rows, k, rounds, 4)


@pytest.mark.parametrize("reach", [1e4, 3e5, 1e9, 1e15, 1e30, 1.7e308])
def test_large_components(spark, reach):
    """Products beyond 2^53 and 2^63: unbounded integers, and null where a long is too short."""
    rows = vectors(6, 40, reach=reach) + vectors(7, 10)
    assert run(spark, rows, 4, 5) == plain(rows, 4, 5, 4)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(20)] + [(i, [0.5, 0.0, 0.0, 0.0]) for i in range(20, 24)]
    for k in (2, 6, 24):
        assert run(spark, rows, k) == plain(rows, k, 10, 4)


def test_nothing_to_cluster(spark):
    assert run(spark, []) == [] and run(spark, [(2, None), (3, [1.0]), (None, [float("nan")] * 4)]) == []


def test_distances_are_exact_at_every_bound():
    r = random.Random(9)
    for bits in (8, 20, 22, 23, 24, 25, 28, 29, 30, 40, 62, 70, 1000):
        rows = [[r.randint(-(2**bits), 2**bits) for _ in range(64)] for _ in range(5)]
        c = [[r.choice((-1, 1)) * 2**bits for _ in range(64)] for _ in range(3)]
        got = centroids.distances(centroids.narrow(rows), centroids.narrow(c))
        assert got.tolist() == [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in rows]
        back = centroids.unpack(pa.array(centroids.pack(centroids.narrow(rows)), pa.binary()), 64)
        assert back.tolist() == rows
    mixed = np.array([[2**70] * 4, [5] * 4, [-(2**40)] * 4], object)
    assert centroids.unpack(pa.array(centroids.pack(mixed), pa.binary()), 4).tolist() == mixed.tolist()
