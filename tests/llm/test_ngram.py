import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from wordmaker import vocabulary

from tessera.llm import ngram
from tessera.sources.scratch import Scratch


def toks(t):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]


def plain_model(texts):
    """The same model from dictionaries."""
    pair, word = Counter(), Counter()
    for t in texts:
        w = toks(t)
        word.update(w)
        pair.update(zip(["<s>", *w[:-1]], w, strict=True))
    total, succ, before = Counter(), defaultdict(Counter), Counter()
    for (u, w), c in pair.items():
        total[u] += c
        succ[u][min(c, 3)] += 1
        before[w] += 1
    high = ngram.discounts([sum(c == k for c in pair.values()) for k in (1, 2, 3, 4)])
    low = ngram.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    v, n = len(word), sum(word.values())
    free = sum(low[min(b, 3) - 1] for b in before.values()) / len(pair) if pair else 1.0

    def p(u, w):
        b = before[w]
        q = (max(b - low[min(b, 3) - 1], 0) if b else 0) / len(pair) + free / (v + 1) if pair else 1 / (v + 1)
        if not total[u]:
            return q
        c = pair[u, w]
        own = max(c - high[min(c, 3) - 1], 0) if c else 0
        return own / total[u] + sum(high[k - 1] * succ[u][k] for k in (1, 2, 3)) / total[u] * q

    return p, word, n, v, [*succ]


@pytest.mark.parametrize("heavy", [False, True])
def test_scores_are_those_of_the_plain_model(spark, edge, edge_rows, none, monkeypatch, heavy):
    if heavy:  # all that a small corpus has is spread by pair
        real = ngram.heavy_contexts
        monkeypatch.setattr(ngram, "heavy_contexts", lambda texts, parts: real(texts, 2000))
    train = edge.where(~ngram.held_out(F.col("doc_id")))
    model = ngram.train(train, Scratch(spark, "test"))
    assert bool(len(model.heavy)) == heavy
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    p, word, n, v, contexts = plain_model([r[1] for r in edge_rows if not held(r[0])])
    assert (model.tokens, model.vocabulary) == (n, v)
    got = sorted(ngram.score(edge, model).collect(), key=str)
    want = []
    for i, t, *_ in edge_rows:
        w = toks(t)
        s = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True))
        want.append((i, len(w), sum(word[x] > 0 for x in w), sum(math.log10((word[x] + 1) / (n + v + 1)) for x in w), s))
    key = lambda x: (str(x[0]), x[1], round(x[4], 3))
    flat = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=key)
    for a, b in zip(flat, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * len(str(b)) + 1e-6 * abs(b[3]) and abs(a[4] - b[4]) < 1e-6 * abs(b[4]) + 1e-9
    for u in contexts[:20]:
        assert abs(sum(p(u, w) for w in word) + p(u, "never seen") - 1) < 1e-9
    assert ngram.score(none, model).count() == 0


def test_beats_the_base_on_rows_held_out(spark):
    r, words = random.Random(6), vocabulary(5)
    after = {w: r.sample(words, 4) for w in words}

    def chain(n):
        out = [r.choice(words)]
        while len(out) < n:
            out.append(r.choice(after[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, chain(80)) for i in range(300)], "doc_id long, text string")
    model = ngram.train(docs.where(~ngram.held_out(F.col("doc_id"))), Scratch(spark, "test"))
    s = ngram.score(docs, model).where(ngram.held_out(F.col("doc_id"))).agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > 0.5 * s[1]


def test_no_training_rows(spark, edge, edge_rows):
    model = ngram.train(edge.where("false"), Scratch(spark, "test"))
    out = ngram.score(edge, model).collect()
    assert len(out) == len(edge_rows) and all(r["n_known"] == 0 and r["score"] == 0 for r in out)


def test_blobs_round_trip():
    import numpy as np

    r = np.random.default_rng(3)
    u, w, c = ngram._merge(r.integers(0, 5, 50, dtype=np.uint64), r.integers(0, 9, 50, dtype=np.uint64), np.ones(50, np.int64))
    back = ngram.unpack(ngram.pack(u, w, c))
    assert all((a == b).all() for a, b in zip((u, w, c), back, strict=True)) and c.sum() == 50
