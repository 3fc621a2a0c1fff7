import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import mixing


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 300))
def test_fit_never_passes_the_budget_and_reaches_what_can_be_reached(cells, budget):
    size, n = np.array(sorted(cells)), np.array([cells[k] for k in sorted(cells)])
    take = mixing.fit(size, n, budget)
    assert ((take >= 0) & (take <= n)).all()
    total = int((size * n).sum())
    got = int((size * take).sum())
    assert got <= budget or total <= budget
    reach = {0}
    for s, c in cells.items():
        reach = {r + s * k for r in reach for k in range(c + 1)}
    best = max(r for r in reach if r <= budget)
    assert got == (total if budget >= total else best)


def test_fit_closes_a_large_gap():
    r = np.random.default_rng(1)
    size = np.unique(r.integers(1, 20_000, 500))
    n = r.integers(1, 4, len(size))
    budget = int((size * n).sum() * 0.41)
    assert int((size * mixing.fit(size, n, budget)).sum()) == budget


def best_sum(cells, budget):
    reach = 1
    for s, c in cells:
        for _ in range(c):
            reach |= reach << s
    return (reach & ((1 << budget + 1) - 1)).bit_length() - 1


def test_fit_is_exact_in_random_cases():
    r = np.random.default_rng(4)
    for _ in range(3000):
        size = np.unique(r.integers(1, r.integers(3, 60), r.integers(1, 8)))
        n = r.integers(1, 7, len(size))
        budget = int(r.integers(0, int((size * n).sum()) + 1))
        got = int((size * mixing.fit(size, n, budget)).sum())
        assert got == best_sum(list(zip(size.tolist(), n.tolist(), strict=True)), budget)
    cells = [(7, 2), (11, 3), (15, 1), (28, 1), (35, 5), (37, 6)]
    assert int((np.array([s for s, _ in cells]) * mixing.fit(np.array([s for s, _ in cells]), np.array([c for _, c in cells]), 348)).sum()) == best_sum(cells, 348)


def test_fit_with_long_documents():
    take = lambda size, n, budget: mixing.fit(np.array(size), np.array(n), budget)
    assert take([69_000, 80_000], [1, 1], 70_000).tolist() == [1, 0]
    assert take([69_000, 80_000, 90_001], [1, 1, 1], 165_000).tolist() == [1, 0, 1]
    r = np.random.default_rng(6)
    for _ in range(40):
        size = np.unique(r.integers(60_000, 400_000, 7))
        n = r.integers(1, 3, len(size))
        budget = int((size * n).sum() * r.random())
        assert int((size * mixing.fit(size, n, budget)).sum()) == best_sum(list(zip(size.tolist(), n.tolist(), strict=True)), budget)
    many = mixing.fit(np.array([0, 1000, 3000]), np.array([5, 10**9, 10**9]), 10**12 + 17)
    assert int(many[1] * 1000 + many[2] * 3000) == 10**12
    bounded = mixing.fit(np.array([2 << 20, 3 << 20, (1 << 22) + 1]), np.array([9, 9, 1]), (1 << 24) + (1 << 19), states=1 << 16)
    assert 0 < int((np.array([2 << 20, 3 << 20, (1 << 22) + 1]) * bounded).sum()) <= (1 << 24) + (1 << 19)


def plain_targets(sizes):
    """Reshare until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 90}, {"a": 1, "b": 1, "c": 500, None: 7}, {"x": 0, "y": 5}, {"only": 3}])
def test_targets_against_the_loop(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (1, 2, 3), 3).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_of_edge_rows(edge, edge_rows, none):
    got = mixing.mix_sources(edge).collect()
    assert len(got) == len(edge_rows)
    words = Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s, *_ in edge_rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == words
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["times"] <= 3 and r["taken"] == r["times"] * r["size"]
    want = plain_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in want:
        assert abs(taken[s] - want[s]) <= max(r["size"] for r in got if r["source"] == s)
    again = mixing.mix_sources(edge.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    rows = mixing.repeat_rows(mixing.mix_sources(edge), edge.columns)
    assert rows.columns == edge.columns and rows.count() == sum(r["times"] for r in got)
    assert mixing.mix_sources(none).count() == 0


def test_rows_of_one_id_and_text_go_by_their_other_columns(spark):
    rows = [(1, "a b c d e", "s", k, {"k": k}) for k in range(12)] + [(2, "one two three", "t", 0, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int, tags map<string,int>")
    seen = [Counter((r["doc_id"], r["rank"], r["times"]) for r in mixing.mix_sources(docs.repartition(k)).collect()) for k in (1, 3, 5)]
    assert seen[0] == seen[1] == seen[2]


def test_few_long_lengths_are_fitted_exactly():
    """Sums beyond the program's window, but few of them."""
    lengths, counts = np.array([30_000_001, 40_000_003, 50_000_007]), np.array([2, 2, 2])
    take = mixing.fit(lengths, counts, 100_000_013)
    assert int((take * lengths).sum()) == 100_000_005 and (take <= counts).all()
    r = random.Random(21)
    for _ in range(300):
        n = r.randint(1, 4)
        lengths = np.array(sorted(r.sample(range(1, 10**9), n)))
        counts = np.array([r.randint(0, 3) for _ in range(n)])
        budget = r.randint(0, int((lengths * counts).sum()) + 5)
        best = max(s for c in product(*[range(k + 1) for k in counts]) if (s := int((np.array(c) * lengths).sum())) <= budget)
        take = mixing.fit(lengths, counts, budget, 300)
        assert int((take * lengths).sum()) == best and (take >= 0).all() and (take <= counts).all()
