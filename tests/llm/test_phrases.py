import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from wordmaker import prose, vocabulary

from tessera.llm import phrases
from tessera.sources.scratch import Scratch


def plain(rows, longest, least, top):
    """The same by dictionaries."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    most = Counter()
    for (lang, p), a in candidates.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                most[lang, p[i : i + n]] = max(most[lang, p[i : i + n]], a)
    for (lang, p), a in candidates.items():
        if (lang, p) in most and 100 * most[lang, p] >= 50 * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, score, a, " ".join(p), left, right))
    ranked, seen = [], Counter()
    for lang, score, a, p, left, right in sorted(out, key=lambda x: (x[0].encode(), -x[1], -x[2], x[3].encode())):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p, a, left, right, total[lang], score))
    return sorted(ranked)


def texts(seed=5, n=260):
    r, words = random.Random(seed), vocabulary(1, 40)
    rows = [(i, r.choice(["", "A B "]) + prose(r, words, r.randint(0, 90)) + r.choice(["", " a b a b a b", "\ta b c\nd", "! a  b, c"]), r.choice(["en", "en", "de", None, "und", ""]), i) for i in range(n)]
    return [*rows, (None, None, None, 0), (1, "", "en", 0), (1, " .,; ", "fr", 0), (2, "a b " * 30000, "en", 1), (3, "x " * 11, "xx", 1), (3, "日本 ÉÈ 日本 ÉÈ! " * 12, "ja", 1)]


SCHEMA = "doc_id long, text string, lang string, n long"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).withColumn("key", F.lit(1)).withColumn("phrase", F.lit("p")).withColumn("w1", F.lit(2))


@pytest.mark.parametrize(("longest", "least", "top", "bits"), [(3, 10, 2000, 64), (3, 10, 7, 9), (2, 4, 50, 64), (4, 6, 2000, 12)])
def test_phrases_are_those_of_the_plain_count(spark, corpus, longest, least, top, bits):
    """With few bits of a key, many words share theirs."""
    got = phrases.collocations(corpus, Scratch(spark, "test"), longest, least, top, bits)
    assert sorted(map(tuple, got.collect())) == plain([(t, g) for _, t, g, _ in texts()], longest, least, top)


@pytest.mark.parametrize("share", [1, 1000])
def test_heavy_prefixes_are_split(spark, corpus, monkeypatch, share):
    real, lists = phrases._heavy, []
    monkeypatch.setattr(phrases, "_heavy", lambda seen, totals, parts: lists.append(real(seen, totals, parts * share)) or lists[-1])
    got = phrases.collocations(corpus, Scratch(spark, "test"))
    assert len(lists[0])
    assert sorted(map(tuple, got.collect())) == plain([(t, g) for _, t, g, _ in texts()], 3, 10, 2000)


def test_many_parts_in_few_partitions(spark, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "PART_BYTES", 2000)
    monkeypatch.setattr(phrases, "MOST_PARTITIONS", 3)
    got = phrases.collocations(corpus, Scratch(spark, "test"))
    assert sorted(map(tuple, got.collect())) == plain([(t, g) for _, t, g, _ in texts()], 3, 10, 2000)


def test_empty_tables(spark, corpus):
    for none in (corpus.where("false"), corpus.where("text is null"), corpus.where("doc_id = 3")):
        got = phrases.collocations(none, Scratch(spark, "test")).collect()
        assert bool(got) == (none.where("text <> ''").count() > 0)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 10^13: a * a * 10^6 has 32 digits."""
    huge = 10**13
    rows = [(1, 11, 0, 0, 7, huge + 7), (1, 12, 0, 0, 7, huge + 9), (2, 11, 12, 0, 7, huge)]
    frame = spark.createDataFrame(rows, "size int, w1 long, w2 long, w3 long, g long, n long")
    listed = spark.createDataFrame([(11, "en", "a"), (12, "en", "b")], "key long, lang string, word string")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: phrases.Frequent(frame, listed, spark.createDataFrame([("en", 5 * huge)], "lang string, n long")))
    got = phrases.collocations(frame, Scratch(spark, "test")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", huge, huge + 7, huge + 9, 5 * huge, 10**6 * huge**2 // ((huge + 7) * (huge + 9)))]


def test_packing(longest=3):
    r = np.random.default_rng(1)
    columns = [r.integers(0, 9, 500).astype(np.uint64) for _ in range(longest)]
    columns, n = phrases.counted(columns, r.integers(1, 2**40, 500))
    lang = columns[0] * np.uint64(77)
    back, of, m = phrases.unpack(phrases.pack(columns, lang, n), longest)
    assert all((a == b).all() for a, b in zip(columns, back, strict=True)) and (of == lang).all() and (m == n).all()
