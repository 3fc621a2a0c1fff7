"""The whole query sets against brute force on the smallest tables."""

import math
from collections import defaultdict
from pathlib import Path

import pytest

from tessera.operators import graph
from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    edges = [tuple(r) for r in catalogue.view(spark, DATA, "edges").select("src_id", "dst_id", "kind", "confidence").collect()]
    return edges, [tuple(r) for r in catalogue.view(spark, DATA, "symbols").select("symbol_id", "path", "name").collect()]


def impact(edges, groups, depth=4, most=500):
    """{(seed, node): (depth, confidence)} by a plain level search."""
    back = defaultdict(dict)
    for s, d, kind, c in edges:
        if kind in graph.IMPACT_KINDS and s is not None and d is not None:
            back[d][s] = max(c or 0.5, back[d].get(s, 0))
    out = {}
    for seed, nodes in groups.items():
        seen, front, got = set(nodes), dict.fromkeys(nodes, 1.0), []
        for level in range(1, depth + 1):
            new = {}
            for node, held in front.items():
                for s, c in back[node].items():
                    if s not in seen:
                        new[s] = max(new.get(s, 0), min(held, c))
            got += sorted((level, -c, s) for s, c in new.items())
            seen |= set(new)
            front = new
        out |= {(seed, s): (level, -c) for level, c, s in got[:most]}
    return out


def test_blast_radius_of_every_twentieth_symbol(spark, tables):
    edges, symbols = tables
    ids = [i for i, _, _ in symbols if i % 20 == 0]
    want = impact(edges, {i: [i] for i in ids})
    got = {(r["seed"], r["symbol_id"]): (r["depth"], r["min_confidence"]) for r in catalogue.QUERIES["blast_radius"](spark, DATA).collect()}
    assert len(ids) > 5 and got.keys() == want.keys() and max(d for d, _ in want.values()) > 3
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.00051 for k in want)
    grouped = catalogue.QUERIES["blast_grouped"](spark, DATA).collect()
    assert {r["seed"] for r in grouped} == {s for s, _ in want} and sum(r["n"] for r in grouped) == len(want)


@pytest.mark.parametrize("most", [3, 20, 60, 400])
def test_full_seeds_stop_without_loss(spark, tables, most):
    edges, symbols = tables
    df = catalogue.view(spark, DATA, "edges")
    seeds = catalogue._every_twentieth(catalogue.view(spark, DATA, "symbols"))
    want = impact(edges, {i: [i] for i, _, _ in symbols if i % 20 == 0}, most=most)
    got = {(r["seed"], r["symbol_id"]): r["depth"] for r in graph.blast_radius(df, seeds, max_nodes=most).collect()}
    assert got == {k: d for k, (d, _) in want.items()}


def test_component_impact_at_full_depth(spark, tables):
    edges, symbols = tables
    groups = defaultdict(list)
    for i, path, _ in symbols:
        if path.startswith("apps/worker"):
            groups["Brand " + path.split("brand_")[1].split("/")[0]].append(i)
    want = defaultdict(list)
    for (seed, _), (_, c) in impact(edges, groups).items():
        want[seed].append(c)
    got = {r["seed"]: (r["total"], r["confidence"]) for r in catalogue.QUERIES["component_impact"](spark, DATA).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(got[k][1] - sum(v)) < 0.01 + 0.0005 * len(v) for k, v in want.items())


def test_call_flow_of_every_twentieth_symbol(spark, tables):
    edges, symbols = tables
    out = {}
    for s, d, kind, c in edges:
        if kind in graph.FLOW_KINDS and s is not None and d is not None:
            out[s, d] = min((-(c or 0.5), kind), out.get((s, d), (1, "")))
    after = defaultdict(list)
    for (s, d), (c, kind) in out.items():
        after[s].append((c, d, kind))
    want = []
    for seed in (i for i, _, _ in symbols if i % 20 == 0):
        seen, front, steps = {seed}, [seed], []
        for depth in range(1, 4):
            new = []
            for node in front:
                for _, d, _ in sorted(after[node]):
                    steps.append((seed, len(steps) + 1, node, d, depth))
                    if d not in seen:
                        seen.add(d)
                        new.append(d)
            front = new
        want += steps[:100]
    got = catalogue.QUERIES["call_flow"](spark, DATA).select("seed", "step", "src_id", "dst_id", "depth").collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(w[4] for w in want) == 3


def test_nearest_of_every_twentieth_vector(spark):
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in catalogue.view(spark, DATA, "embeddings").collect()}
    want = set()
    norm = {i: math.sqrt(math.fsum(x * x for x in v)) for i, v in vectors.items()}
    for q in (i for i in vectors if i % 20 == 0):
        near = sorted((1 - sum(x * y for x, y in zip(vectors[q], v, strict=True)) / (norm[q] * norm[i]), i) for i, v in vectors.items())[:10]
        want |= {(q, i) for _, i in near}
    got = catalogue.QUERIES["knn_cosine"](spark, DATA).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == want and len(got) == len(want) > 10
