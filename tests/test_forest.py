import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import forest, graph
from tessera.sources.scratch import Scratch


class Parts:
    def __init__(self, ids, pairs=()):
        self.up = {x: x for x in ids}
        for a, b in pairs:
            self.join(a, b)

    def __call__(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        x, y = sorted((self(a), self(b)))
        self.up[y] = x
        return x != y


def plain_forest(pairs):
    """Sorted edges, heaviest first."""
    made = Parts({x for a, b, _ in pairs for x in (a, b)})
    return sorted((a, b, w) for w, a, b in sorted(((w, a, b) for a, b, w in pairs), reverse=True) if made.join(a, b))


def plain_clusters(ids, pairs, share=0.6):
    """Components over strong edges; every cut of a large one is tried."""
    peak = Counter()
    for a, b, w in pairs:
        peak[a], peak[b] = max(peak[a], w), max(peak[b], w)
    whole = Parts(ids, [(a, b) for a, b, w in pairs if w + 1e-9 >= 0.45 * max(peak[a], peak[b])])
    out = {x: whole(x) for x in ids}
    for root, size in Counter(out.values()).items():
        mine = [x for x in ids if whole(x) == root]
        pair = [(a, b) for w, a, b in sorted((w, a, b) for a, b, w in pairs if whole(a) == root == whole(b))]
        if size < 8 or len(pair) < 2:
            continue
        for cut in range(1, max(1, len(pair) // 5) + 1):
            made = Parts(mine, pair[cut:])
            big = [n for n in Counter(made(x) for x in mine).values() if n >= 3]
            if len(big) >= 2 and sum(big) >= int(share * len(mine)):
                out |= {x: made(x) for x in mine}
                break
    return out


def graphs(seed, many):
    """Connected graphs of two or three dense parts with few links, of chains and stars, with many equal weights."""
    r, nodes, pairs = random.Random(seed), [], {}
    for g in range(many):
        ids = [f"g{g:03}/n{i:02}" for i in range(r.randint(4, 22))]
        parts = r.choice([1, 2, 2, 3])
        for p in range(parts):
            part = ids[p::parts]
            for i in range(1, len(part)):
                pairs[part[r.randrange(i) if r.random() < 0.8 else 0], part[i]] = r.choice([4, 5, 5, 6, 7.5])
            for _ in range(len(part)):
                if len(part) > 2:
                    pairs[tuple(sorted(r.sample(part, 2)))] = r.choice([4, 5, 6])
        for p in range(1, parts):
            for _ in range(r.choice([1, 1, 2])):
                pairs[tuple(sorted((r.choice(ids[0::parts]), r.choice(ids[p::parts]))))] = r.choice([3, 3, 3.5])
        nodes += ids
    return nodes, [(a, b, float(w)) for (a, b), w in pairs.items() if a != b]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_the_forest_is_that_of_sorted_edges(spark):
    _, pairs = graphs(1, 30)
    pairs = [(min(a, b), max(a, b), w) for a, b, w in pairs]
    frame = spark.createDataFrame(pairs, "a string, b string, w double").dropDuplicates(["a", "b"])
    pairs = [tuple(r) for r in frame.collect()]
    got = forest.spanning_forest(spark.createDataFrame(pairs, "a string, b string, w double"), Scratch(spark, "t"), graph.connected_components)
    assert rows(got) == plain_forest(pairs)
    assert forest.spanning_forest(frame.where("false"), Scratch(spark, "t"), graph.connected_components).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_clusters_are_those_of_every_cut_tried(spark, seed):
    ids, pairs = graphs(seed, 120)
    merged = Counter()
    for a, b, w in pairs:
        merged[min(a, b), max(a, b)] += w
    want = plain_clusters(ids, [(a, b, w) for (a, b), w in merged.items()])
    got = graph.clusters(spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string, weight double"))
    linked = {x for k in merged for x in k}
    assert {k: v for k, v in got.collect() if k in linked} == {k: v for k, v in want.items() if k in linked}
    whole = plain_clusters(ids, [(a, b, w) for (a, b), w in merged.items()], share=2)
    assert sum(want[x] != whole[x] for x in ids) > 30


def test_no_group_runs_in_pandas(spark):
    ids, pairs = graphs(5, 3)
    plan = graph.clusters(spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string, weight double"))._jdf.queryExecution().toString()
    assert not re.search("Pandas|Python", plan)


def test_evidence_and_labels(spark):
    pairs = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 5.0), ("a", "c", 3.0), ("c", "d", 9.0), ("d", "e", 1.0)], "a string, b string, w double")
    member = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y")], "id string, cluster string")
    assert rows(forest.evidence_edges(pairs, member, most=2)) == [("x", "a", "b", 3.0, 2), ("x", "b", "c", 5.0, 1), ("y", "d", "e", 1.0, 1)]
    assert rows(forest.evidence_edges(pairs, member, inner=False)) == [("x", "c", "d", 9.0, 1), ("y", "c", "d", 9.0, 1)]
    labels = spark.createDataFrame([("x", " Billing \n core ", ["a", "c"]), ("x", "Auth", ["a", "d"]), ("y", "Web", []), ("y", "bad[1]", ["d"]), ("y", "n" * 81, ["d"]), ("y", None, ["d"]), ("z", "Gone", ["a"]), ("y", "Two", None)], "cluster string, name string, paths array<string>")
    assert rows(forest.accepted_labels(labels, member)) == [("x", "Billing core")]


def test_components_keep_one_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "Scratch", lambda *a: made.append(Scratch(*a)) or made[-1])
    edges = spark.createDataFrame([(f"v{i:03}", f"v{i + 1:03}") for i in range(60)], "a string, b string")
    nodes = edges.select(F.col("a").alias("id"))
    assert {r["component"] for r in graph.connected_components(nodes, edges).collect()} == {"v000"}
    assert len(os.listdir(made[0].root.removeprefix("file://"))) == 1


def test_forest_rounds_keep_no_ends(spark):
    scratch = Scratch(spark, "t")
    pairs = spark.createDataFrame([(f"v{i:03}", f"v{i + 1:03}", float(i % 7)) for i in range(60)], "a string, b string, w double")
    assert forest.spanning_forest(pairs, scratch, graph.connected_components).count() == 60
    left = {n.split("-")[0] for n in os.listdir(scratch.root.removeprefix("file://")) if not n.endswith(".crc")}
    assert "edges" not in left and "name" not in left


def test_forest_in_parts_of_bounded_size(spark, monkeypatch, tmp_path):
    """Thinned in parts, by cluster, in one part or in rounds: always the edges of a single pass over the sorted edges."""
    import random

    from tessera.operators import forest, graph
    from tessera.sources.scratch import Scratch

    rng = random.Random(5)
    # A dense cluster that thins to one part, and a long path that never does.
    dense = {(f"a{i:03}", f"a{j:03}", float(rng.randint(1, 9))) for i in range(12) for j in range(i + 1, 12)}
    path = {(f"b{i:03}", f"b{i + 1:03}", float(rng.randint(1, 9))) for i in range(70)}
    lone = {("c0", "c1", 1.0)}
    edges = [("A", *e) for e in sorted(dense)] + [("B", *e) for e in sorted(path)] + [("C", *e) for e in sorted(lone)]
    parent, want = {}, []
    for _, a, b, w in sorted(edges, key=lambda e: (e[3], e[1], e[2]), reverse=True):
        x, y = forest.root_of(parent, a), forest.root_of(parent, b)
        if x != y:
            parent[x] = y
            want.append((a, b, w))
    rows = spark.createDataFrame(edges, "cluster string, a string, b string, w double")
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (written.append(name), table(self, df, name))[1])
    found = lambda df: sorted(tuple(r) for r in forest.spanning_forest(df, Scratch(spark, "test"), graph.connected_components).collect())
    assert found(rows) == sorted(want)
    assert written == ["thin-0", "thin-1"]
    monkeypatch.setattr(forest, "PART", 20)
    assert found(rows) == sorted(want)
    assert "best-1" in written
    got = {r["id"]: r["component"] for r in graph.connected_components(rows.selectExpr("explode(array(a, b)) as id"), rows).collect()}
    assert got == {v: {"a": "a000", "b": "b000", "c": "c0"}[v[0]] for v in got} and len(got) == 85
