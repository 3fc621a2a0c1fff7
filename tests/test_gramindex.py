import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import gramindex, retrieval
from tessera.sources.scratch import Scratch

TEXTS = ["", "a", "ab", "abc", "abcabc", "xabcy", "ABC", "ünïcode ß", "日本語のテキスト", "a\nb\nabc def", "parse_args(argv)", "Licensed under MIT", "licence UNDER x", "\U0001f600 smile \U0001f600", None, "aaaaaa", "tab\there", "a.b.c"]


def corpus(seed, n=120):
    r = random.Random(seed)
    return TEXTS + ["".join(r.choice("abcé \n") for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("bits", [14, 2])
def test_containment_is_that_of_all_pairs(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(gramindex, "BLOCK_BITS", bits)
    texts, r = corpus(1), random.Random(2)
    needles = ["", "a", "b", "ab", "abc", "é ", "zzz", "zz", "z", "本語", "\U0001f600", "aaaa", "c\na", None, "parse_args", "ABC", ".", "a.b"] + ["".join(r.choice("abcé \n") for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, body string").repartition(3)
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "ask_id long, needle string")
    index = gramindex.build(rows, str(tmp_path / "i"), F.col("body"))
    got = gramindex.GramIndex(spark, str(tmp_path / "i")).containing(asked).select("ask_id", "key").collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, n in enumerate(needles) for k, t in enumerate(texts) if n is not None and t is not None and n in t)
    # A block's list is bounded, whatever the gram.
    assert index.postings().selectExpr("max(size(ids))").first()[0] <= 1 << bits
    held = {sum((ord(c) + 1) << (42 - 21 * j) for j, c in enumerate(t[i : i + k])) for t in texts if t for k in (1, 2, 3) for i in range(len(t) - k + 1)}
    assert {x[0] for x in index.totals().select("gram").collect()} == held


def test_no_nested_loop_in_the_plans(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(corpus(3))), "key long, body string")
    asked = spark.createDataFrame([(1, "abc"), (2, "b")], "ask_id long, needle string")
    symbols = spark.createDataFrame([(i, t, "p", i) for i, t in enumerate(corpus(3))], "symbol_id long, name string, path string, start_line int")
    plans = [gramindex.build(rows, str(tmp_path / "i"), F.col("body")).containing(asked), retrieval.symbol_ladder(symbols, asked.toDF("query_id", "query"))]
    for p in plans:
        assert not re.search("NestedLoop|Cartesian", p._jdf.queryExecution().toString())


def ladder(symbols, names):
    """By the rule: exact, case-blind, prefix, substring; the best of a path."""
    out = []
    for q, text in names:
        if text is None:
            continue
        t, best = text.strip(" "), {}
        for i, name, path, line in symbols:
            if name is None:
                continue
            low, ql = name.lower(), t.lower()
            score = 100 if name == t else 90 if low == ql else 70 if low.startswith(ql) else 50 if ql in low else None
            if score and (path not in best or (-score, line, i) < best[path][0]):
                best[path] = ((-score, line, i), name)
        for rank, (path, ((s, line, i), name)) in enumerate(sorted(best.items(), key=lambda x: (x[1][0][0], x[0], x[1][0][1])), 1):
            out.append((q, rank, path, i, name, line, -s))
    return sorted(out)


def test_the_ladder_over_the_index(spark):
    r = random.Random(4)
    symbols = [(i, r.choice(["", "get", "Get", "get_user", "getUser", "forget", "x", "UserGet", "ÜBER", "über"]) + r.choice(["", "s", "X"]) if i % 9 else None, f"p{i % 17}", i % 5) for i in range(150)]
    names = [(1, "get"), (2, "GET "), (3, ""), (4, None), (5, "Über"), (6, "x"), (7, "nothing"), (8, "getuser"), (9, " "), (10, "get")]
    got = retrieval.symbol_ladder(spark.createDataFrame(symbols, "symbol_id long, name string, path string, start_line int"), spark.createDataFrame(names, "query_id long, query string"))
    assert sorted(map(tuple, got.collect())) == ladder(symbols, names)


PATTERNS = ["abc", "a.c", "ab|cd", "(abc|x)y", "li[cs]en[cs]ed? under", "^a", "b$", "a{2,}", "(ab){2}c", "x*abc", "a?bc", "[^a]bc", "\\w+abc", "a\\.b", "parse_\\w+\\(", "日本", "é", "(?i)ABC", "(?=ab)abc", "[a-c]bc", "[[:alpha:]]b", "\\p{L}bc", "a&&b", "abc.{3}def", "(?:MIT|BSD)"]


@pytest.mark.parametrize("ignore", [False, True])
def test_grep_over_the_index_is_grep(spark, tmp_path, ignore):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(corpus(5))], "path string, text string")
    index = retrieval.file_lines(files, str(tmp_path / "i"))
    for pattern in PATTERNS:
        want = sorted(retrieval.grep(files, pattern, ignore, limit=None).collect())
        assert sorted(retrieval.grep(None, pattern, ignore, limit=None, index=index).collect()) == want, pattern


def test_what_an_expression_requires():
    r = gramindex.required
    assert sorted(map(tuple, r("licen[cs]ed? under"))) == [("licence under",), ("licenced under",), ("license under",), ("licensed under",)]
    assert r("Abc.*dEf") == [["abc", "def"]] and r("(a|b)cd") == [["acd"], ["bcd"]]
    assert r(".*") is None and r("a?") is None and r("abc|.*") is None and r("(") is None and r("[a&&b]x") is None and r("\\Qabc\\E") is None
    assert r("x{2,5}yz") == [["xx", "yz"]] and r("a\\b") == [["a"]]
    assert r("(abcd|" * 20 + "z" + ")" * 20) is not None


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"([abc]|a\?|b\+|\(ab\|c\)|\[ab\]|c\{2\}|\.){1,8}", fullmatch=True), st.text(alphabet="abcABC", max_size=12))
def test_every_match_holds_an_alternative(pattern, text):
    ways = gramindex.required(pattern)
    if re.search(pattern, text) and ways is not None:
        low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        assert any(all(x in low for x in way) for way in ways)


def test_catalogue_scores_by_parts(spark):
    entries = [(1, "http", "List users", "/users", "a.py"), (2, "job", "Nightly sync", "sync_all", "b.py"), (3, "http", "Users", "/u", None), (4, "webhook", None, None, "c.py"), (5, "job", "x", "", "a.py")]
    questions = [(1, "How does /users list users?"), (2, "run SYNC_ALL nightly"), (3, None), (4, "nothing here at all")]
    hits = [(1, 1, "a.py"), (4, 1, "c.py"), (4, 2, "a.py")]
    e = spark.createDataFrame(entries, "entry_id long, kind string, title string, literal string, path string")
    q = spark.createDataFrame(questions, "query_id long, query string")
    h = spark.createDataFrame(hits, "query_id long, rank int, path string")
    tokens = lambda t: set(re.findall("[a-z0-9]{3,}", (t or "").lower()))
    want = []
    for qi, text in questions:
        for i, kind, title, literal, path in entries:
            score = len(tokens(" ".join(x for x in (title, literal) if x is not None)) & tokens(text))
            score += (4 if kind == "job" else 5) if literal and len(literal) > 1 and text and literal.lower() in text.lower() else 0
            score += (2 if kind == "http" else 1.5) if (qi, path) in {(a, c) for a, _, c in hits} else 0
            if score:
                want.append((qi, i, float(score)))
    assert sorted(map(tuple, retrieval.catalog_scores(e, q, h).select("query_id", "entry_id", "score").collect())) == sorted(want)
    assert retrieval.catalog_seed(e, q, h).count() == 3
    assert Scratch(spark, "x").root
