import hashlib
import random
from collections import Counter

import pytest

from tessera.operators import history, ownership
from tessera.sources.scratch import Scratch


def plain_reach(commits, heads):
    up, seen, todo = dict(commits), set(), [h for h in heads if h in dict(commits)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [p for p in up[x] or [] if p in up]
    return seen


def history_of(seed, n, branches):
    """Branches with merges, some commits on none that is merged, parents that are unknown or null."""
    r, out, tips = random.Random(seed), [], {}
    for i in range(n):
        b = r.randrange(branches)
        parents = [tips[b]] if b in tips else ([r.randrange(i)] if i and r.random() < 0.7 else [])
        if r.random() < 0.2 and tips:
            parents.append(r.choice(list(tips.values())))
        if r.random() < 0.05:
            parents.append(r.choice([10**6, None]))
        tips[b] = i
        out.append((i, parents or None))
    return out


@pytest.mark.parametrize(("seed", "n", "branches", "heads"), [(1, 60, 3, [59]), (2, 80, 12, [70, 3]), (3, 40, 1, [39]), (4, 30, 30, [29, 999]), (5, 5, 2, [])])
def test_reach_is_that_of_a_plain_walk(spark, seed, n, branches, heads):
    commits = history_of(seed, n, branches)
    frame = spark.createDataFrame([*commits, (None, [1]), (commits[0][0], commits[0][1])], "sha long, parents array<long>")
    got = history.reachable(frame, spark.createDataFrame([(h,) for h in heads], "sha long")).collect()
    assert sorted(r[0] for r in got) == sorted(plain_reach(commits, heads))


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    """2,000 commits in a row: 11 tables, one round."""
    frame = spark.range(2000).selectExpr("id as sha", "if(id = 0, null, array(id - 1)) as parents", "timestamp_seconds(id) as committed_at")
    names = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: names.append(name) or table(self, df, name))
    walked = ownership.commit_walk(frame, spark.createDataFrame([(7,)], "sha long"), 3, spark.createDataFrame([(1500,)], "sha long")).collect()
    assert [r["sha"] for r in walked] == [1500, 1499, 1498]
    assert len(names) < 40


def lines_of(text):
    c = Counter(text.split("\n"))
    return c, sum(n * (len(x.encode()) + 1) for x, n in c.items())


def plain_similarity(a, b):
    (x, m), (y, n) = lines_of(a), lines_of(b)
    return 100 * sum(min(k, y[t]) * (len(t.encode()) + 1) for t, k in x.items()) // max(m, n)


def plain_renames(files, similar=50):
    out = []
    for sha in {f[0] for f in files}:
        mine = sorted({f for f in files if f[0] == sha and f[3]}, key=lambda f: f[1])
        old, new = [f for f in mine if not f[2]], [f for f in mine if f[2]]
        for text in {f[3] for f in old}:
            out += [(sha, a[1], b[1], 100) for a, b in zip([f for f in old if f[3] == text], [f for f in new if f[3] == text], strict=False)]
        used = {(False, a) for s, a, _, _ in out if s == sha} | {(True, b) for s, _, b, _ in out if s == sha}
        pairs = [(plain_similarity(a[3], b[3]), a[1], b[1]) for a in old for b in new if (False, a[1]) not in used and (True, b[1]) not in used]
        base = lambda p: p.rsplit("/", 1)[-1]
        for s, a, b in sorted((p for p in pairs if p[0] >= similar), key=lambda p: (-p[0], base(p[1]) != base(p[2]), hashlib.md5(f"{sha}\n{p[1]}\n{p[2]}".encode()).hexdigest(), p[1], p[2])):
            if (False, a) not in used and (True, b) not in used:
                used |= {(False, a), (True, b)}
                out.append((sha, a, b, s))
    return sorted(out)


def moved_files(seed, commits=4, n=12):
    r, files = random.Random(seed), []
    common = ["", "}", "import os", "# license", "x = 1"]
    for sha in range(commits):
        for i in range(n):
            text = [r.choice(common) if r.random() < 0.4 else f"line {r.randrange(10**6)}" for _ in range(r.randint(0, 30))]
            files.append((sha, f"old/{i % 5}/f{i}.py", False, "\n".join(text)))
            for j in range(r.choice([0, 1, 1, 2])):
                changed = [x if r.random() > r.choice([0, 0.1, 0.45, 0.6]) else f"new {r.randrange(10**6)}" for x in text]
                files.append((sha, f"new{j}/f{i}.py", True, "\n".join(changed)))
    return files


@pytest.mark.parametrize("seed", range(4))
def test_renames_are_those_of_all_pairs(spark, seed):
    files = moved_files(seed)
    files += [(9, "a", False, ""), (9, "b", True, ""), (9, "c", False, None), (None, "d", True, "x"), (9, None, True, "x"), (9, "é/x", False, "ü\nü\nü"), (9, "é/y", True, "ü\nü\nz"), (9, "only", True, "nothing like it")]
    frame = spark.createDataFrame(files, "sha long, path string, added boolean, text string").repartition(3)
    want = plain_renames([f for f in files if f[0] is not None and f[1] is not None and f[3]])
    assert sorted(map(tuple, history.renames(frame).collect())) == want and len(want) > 20
    pairs = history.similar_pairs(frame, Scratch(spark, "test"), 70)
    kept = [f for f in files if None not in f and f[3]]
    assert sorted(map(tuple, pairs.collect())) == sorted((a[0], a[1], b[1], s) for a in kept for b in kept if a[0] == b[0] and not a[2] and b[2] and (s := plain_similarity(a[3], b[3])) >= 70)


def test_ties_of_many_files_take_few_rounds(spark, monkeypatch):
    """Forty old and forty new files, all alike: no more rounds than their number."""
    body = "\n".join(f"line {i}" for i in range(40))
    files = [(1, f"{side}/{i}.py", side == "n", body + f"\n{side}{i}") for side in "on" for i in range(40)]
    names = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: names.append(name) or table(self, df, name))
    got = history.renames(spark.createDataFrame(files, "sha long, path string, added boolean, text string"))
    assert sorted(map(tuple, got.collect())) == plain_renames(files) and got.count() == 40
    assert sum(n.startswith("best") for n in names) < 15


def test_changes_with_renames(spark):
    found = spark.createDataFrame([(1, "a", "b", 90)], "sha long, old_path string, new_path string, similarity long")
    changes = spark.createDataFrame([(1, "a", "deleted"), (1, "b", "added"), (1, "c", "added"), (2, "a", "deleted"), (1, "d", "modified")], "sha long, path string, change string")
    got = sorted(map(str, map(tuple, history.with_renames(changes, found).select("sha", "path", "change", "old_path").collect())))
    assert got == sorted(map(str, [(1, "b", "renamed", "a"), (1, "c", "added", None), (2, "a", "deleted", None), (1, "d", "modified", None)]))
    assert history.renames(spark.createDataFrame([], "sha long, path string, added boolean, text string")).count() == 0
