import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from wordmaker import prose, vocabulary

from tessera.llm import licences

SMALL = st.lists(st.integers(0, 6), max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=200)
@given(SMALL, SMALL)
def test_alignment_is_common_and_increasing(a, b):
    pairs = licences.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in combinations(pairs, 2))
    assert len(pairs) <= lcs(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == lcs(a, b)


def test_planted_licences(spark, edge, none):
    r, words = random.Random(5), vocabulary(4)
    rows, want = [], set()
    for i, (name, (must, body)) in enumerate(licences.TEMPLATES.items()):
        tokens = body.split(" ")
        rows.append((i, "é " + prose(r, words, 50) + "\n" + body + "\n" + prose(r, words, 50)))
        want.add((i, name))
        key = must.split()
        drop = [k for k, w in enumerate(tokens) if not any(m in w.lower() for m in key)]
        cut = set(r.sample(drop, int(0.15 * len(tokens)))) if len(tokens) > 12 else set()
        rows.append((100 + i, prose(r, words, 9) + " " + " ".join(w.upper() for k, w in enumerate(tokens) if k not in cut) + " " + body))
        want.add((100 + i, name))
        rows.append((200 + i, " ".join(w for k, w in enumerate(tokens) if k % 2)))
    rows += [(900, None), (901, ""), (902, prose(r, words, 400))]
    got = licences.licence_regions(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(x["doc_id"], x["licence"]) for x in got}
    assert want <= found and not any(d >= 200 for d, _ in found)
    for x in got:
        assert 0.8 <= x["coverage"] <= 1 and x["words_aligned"] <= x["template_words"]
    texts = dict(rows)
    first = next(x for x in got if x["doc_id"] == 6 and x["licence"] == "MIT")
    span = texts[6][first["start"] : first["end"]]
    assert span.startswith("Permission is hereby") and span.endswith("Software")
    assert sum(x["doc_id"] == 106 and x["licence"] == "MIT" for x in got) == 2
    assert licences.licence_regions(edge).count() == 0 and licences.licence_regions(none).count() == 0


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
def test_every_licence_line_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lines = {}
    for d in docs.where("lower(text) rlike 'licen[sc]e|rights reserved'").select("doc_id", "text").collect():
        at = 0
        for line in d["text"].split("\n"):
            if "license" in line.lower() or "licence" in line.lower() or "rights reserved" in line.lower():
                lines[d["doc_id"], at, at + len(line.rstrip(" ."))] = line
            at += len(line) + 1
    found = [(x["doc_id"], x["start"], x["end"]) for x in licences.licence_regions(docs).collect()]
    missed = {k: line for k, line in lines.items() if not any(d == k[0] and k[1] <= s and e <= k[2] for d, s, e in found)}
    assert len(lines) >= 46 and not missed


def test_creative_commons_variants_stay_apart(spark):
    rows = [(i, f"one two. Licensed under CC {k} 4.0. three") for i, k in enumerate(["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"])]
    rows += [(6, "Licensed under CC BY-NC 3.0."), (7, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), (8, "all rights are his, some are reserved")]
    got = sorted((x["doc_id"], x["licence"]) for x in licences.licence_regions(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, f"CC-{k}-4.0-short") for i, k in enumerate(["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"])] + [(7, "CC-BY-NC-4.0-statement")]


def exhaustive(sequence, word, must, need):
    """Whether any stretch of the words, from any start to any end, covers the template; by template words alone if it is long enough."""
    own = [i for i, w in enumerate(word) if w in set(sequence)]
    tries = [[i for i in range(s, e)] for s in range(len(word)) for e in range(s + need, min(len(word), s + len(sequence) + max(2, len(sequence) // 4)) + 1)]
    if len(sequence) >= licences.PHRASE:
        tries += [own[s:e] for s in range(len(own)) for e in range(s + need, len(own) + 1)]
    for t in tries:
        pairs = licences.patience(sequence, [word[i] for i in t])
        if len(pairs) >= need and must <= {sequence[i] for i, _ in pairs}:
            return True
    return False


def test_finds_against_every_window():
    """Recall and precision against all windows of random texts that hold edited templates among foreign words."""
    r = random.Random(21)
    both = only = extra = 0
    for _ in range(300):
        size = r.choice([5, 8, 14, 20])
        words = [f"w{r.randrange(size)}" if r.random() < 0.4 else f"t{i}" for i in range(size)]
        key = r.choice([w for w in words if words.count(w) == 1] or words)
        catalogue = licences.Catalogue.of({"x": (key, " ".join(words))})
        text = []
        for _ in range(r.randint(0, 2)):
            text += [f"f{r.randrange(30)}" for _ in range(r.randint(0, 10))]
            gap = r.choice([0, 0, 1, 3])
            for w in words:
                text += [] if r.random() < 0.1 else [w]
                text += [r.choice([f"f{r.randrange(30)}", f"w{r.randrange(size)}"]) for _ in range(r.randint(0, gap))]
        raw = np.frombuffer(" ".join(text).encode(), np.uint8)
        h, *_ = licences.bare_words(raw, np.array([0, len(raw)]))
        at = np.minimum(np.searchsorted(catalogue.vocabulary, h), len(catalogue.vocabulary) - 1)
        place = np.where(catalogue.vocabulary[at] == h, at, -1) if len(h) else np.zeros(0, np.int64)
        got = bool(licences.find(catalogue, place, 0.8))
        want = exhaustive(catalogue.sequences[0], place.tolist(), catalogue.must[0], licences.least_aligned(size, 0.8))
        both, only, extra = both + (got and want), only + (want and not got), extra + (got and not want)
    assert extra == 0 and both >= 100 and both / (both + only) >= 0.95


def test_a_licence_with_foreign_words_between_its_own(spark):
    r, words = random.Random(22), vocabulary(4)
    rows = []
    for i, (name, (_, body)) in enumerate(licences.TEMPLATES.items()):
        tokens = body.split(" ")
        if len(tokens) >= licences.PHRASE + 2:
            rows.append((i, name, " ".join(x for w in tokens for x in (w, *prose(r, words, r.randint(0, 2)).split(" ")))))
            rows.append((1000 + i, name, prose(r, words, 300) + " " + " ".join(w + " " + prose(r, words, 20) for w in tokens) + prose(r, words, 300)))
    got = licences.licence_regions(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()
    found = {(x["doc_id"], x["licence"]) for x in got}
    assert {(i, n) for i, n, _ in rows} == found
    assert all(x["span_words"] > x["template_words"] for x in got if x["doc_id"] >= 1000)


def test_notices_of_one_family_stay_apart(spark):
    names = [n for n in licences.TEMPLATES if n.endswith("or-later") or n in ("ISC", "0BSD", "MIT", "NCSA")]
    docs = spark.createDataFrame([(i, licences.TEMPLATES[n][1]) for i, n in enumerate(names)], "doc_id long, text string")
    assert sorted((x["doc_id"], x["licence"]) for x in licences.licence_regions(docs).collect()) == list(enumerate(names))
