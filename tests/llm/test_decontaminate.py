import random
import re

import numpy as np
import pyarrow as pa
from wordmaker import prose, vocabulary

from tessera.llm import decontaminate as d


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")).encode()


def least_edits(item, text):
    """Fewest edits of the item against any stretch of the text."""
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(prev[j - 1] + (a != b), prev[j] + 1, row[-1] + 1))
        prev = row
    return min(prev)


def edited(r, text, edits):
    t = list(text)
    for _ in range(edits):
        k = r.randrange(len(t))
        kind = r.randrange(3)
        if kind == 0:
            t[k] = "q"
        elif kind == 1:
            del t[k]
        else:
            t.insert(k, "z")
    return "".join(t)


def test_matches_are_exactly_those_within_the_budget():
    r, words = random.Random(8), vocabulary(2)
    items = [(i, prose(r, words, r.randint(10, 40))) for i in range(12)]
    texts = [None, "", "  "]
    for i, t in items:
        for e in (0, 1, 3, 6, 12, 25):
            texts.append(prose(r, words, 20) + " " + edited(r, t.upper() if e == 3 and t.isascii() else t, e).replace(" ", "  \n", 2) + " " + prose(r, words, 15))
    texts += [items[0][1] + " " + items[0][1], items[1][1], prose(r, words, 300)]
    index = d.Index.of(items)
    got = {(a, int(index.ids[0, b])): e for a, b, _, _, e in d.matches(index, pa.array(texts)).tolist()}
    for a, t in enumerate(texts):
        for k, (i, body) in enumerate(items):
            best = least_edits(norm(body).strip(), norm(t))
            assert ((a, i) in got) == (best <= index.budget[k])
            if (a, i) in got:
                assert best <= got[a, i] <= index.budget[k]
    twice = d.matches(index, pa.array([texts[-3]]))
    assert len(twice) == 2


def test_short_items_match_only_whole():
    index = d.Index.of([(1, "the small item"), (2, None), (3, "  ")])
    got = d.matches(index, pa.array(["has The  small item here", "the small items", " the small item", None]))
    assert got[:, 0].tolist() == [0, 2] and index.ids[0].tolist() == [1]
    assert got[0, 2:4].tolist() == [4, 19]


def test_regions_and_clean_rows(spark, edge, edge_rows, none):
    r, words = random.Random(9), vocabulary(2)
    item = prose(r, words, 30)
    docs = edge.unionByName(spark.createDataFrame([(500, "é lead " + item + " tail", "en", "s", 1, 1, "k", "r", 9, 9, 0.5)], edge.schema))
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, item, "x")], "item_id long, text string, doc_id string")
    got = d.contaminated_regions(docs, bench).collect()
    assert sorted((x["doc_id"], x["item_id"], x["edits"]) for x in got) == [(500, 7, 0), (500, 9, 0)]
    assert ("é lead " + item + " tail")[got[0]["start"] : got[0]["end"]] == item
    kept = docs.where(d.is_clean(bench, docs["text"]))
    assert kept.count() == len(edge_rows) and kept.columns == docs.columns
    assert d.contaminated_regions(docs, bench.where("false")).count() == 0 and d.contaminated_regions(none, bench).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    r, words = random.Random(10), vocabulary(2)
    items = [(i, prose(r, words, 25)) for i in range(9)]
    monkeypatch.setattr(d, "ITEM_BYTES", 300)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(d.index_items(bench).blocks) > 2
    docs = spark.createDataFrame([(i, "lead " + t) for i, t in items], "doc_id long, text string")
    assert sorted((x["doc_id"], x["item_id"]) for x in d.contaminated_regions(docs, bench).collect()) == [(i, i) for i, _ in items]
    assert docs.where(d.is_clean(bench, docs["text"])).count() == 0


def test_every_occurrence_of_short_items_with_any_boundary():
    index = d.Index.of([(1, "the small item")])
    text = 'The small item, (the small item) "the small item". \u201cthe small item\u201d; the small items, athe small item \u00e9the small item the small item\u0301 the small item'
    got = d.matches(index, pa.array(["x", text, "the small item"])).tolist()
    found = [text.encode()[a:b].decode() for r, _, a, b, _ in got if r == 1]
    assert len(found) == 5 and {f.lower() for f in found} == {"the small item"}
    assert [r for r, *_ in got].count(2) == 1 and not any(r == 0 for r, *_ in got)


def test_items_of_sixteen_bytes_and_more_match_with_edits():
    r, words = random.Random(11), vocabulary(3)
    items = [(m, prose(r, words, 30).encode().decode("ascii", "ignore")[:m].strip().ljust(m, "k")) for m in range(16, 60)]
    texts = []
    for _, t in items:
        for e in (0, 1, 2, 3, 4, 6):
            texts += [prose(r, words, 6) + ' "' + edited(r, t, e) + '", ' + prose(r, words, 6)]
    index = d.Index.of(items)
    assert index.budget.tolist() == [int(n) // 10 for n in np.diff(index.at)]
    got = {(a, b) for a, b, _, _, _ in d.matches(index, pa.array(texts)).tolist()}
    for a, t in enumerate(texts):
        for k in {a // 6, (a // 6 + 1) % len(items)}:
            assert ((a, k) in got) == (least_edits(index.pattern(k).tobytes(), norm(t)) <= index.budget[k])
    many = d.matches(index, pa.array([" | ".join([items[4][1]] * 30)]))
    assert (many[:, 1] == 4).sum() == 30


def test_every_piece_of_many_short_items():
    """Against plain search: exact items of one byte to fifteen, each with its boundaries."""
    r = random.Random(12)
    items = [(i, "".join(r.choice("ab é") for _ in range(r.randint(1, 15))).strip() or "a") for i in range(60)]
    text = " ".join("".join(r.choice("ab é.") for _ in range(30)) for _ in range(40))
    index = d.Index.of(items)
    got = {(int(index.ids[0, i]), a, b) for _, i, a, b, _ in d.matches(index, pa.array([text])).tolist()}
    plain, at = norm(text), []
    raw = text.encode()
    for k in range(len(raw)):
        if not (k and raw[k : k + 1] == b" " and raw[k - 1 : k] == b" "):
            at.append(k)
    word = lambda c: c.isalnum() or c == "_"
    for i, t in items:
        body, k, free = norm(t).strip(), 0, 0
        while (k := plain.find(body, k)) >= 0:
            left, right = plain[:k].decode(errors="ignore")[-1:], plain[k + len(body) :].decode(errors="ignore")[:1]
            if k >= free and not (left and word(left)) and not (right and word(right)):
                assert (i, at[k], at[k + len(body) - 1] + 1) in got
                free = k + len(body)
            k += 1


def fewest_edits(item, text):
    """Edits from the item to the nearest stretch of the text."""
    t, ramp = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    cell = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(item):
        new = np.append(i + 1, np.minimum(cell[:-1] + (t != c), cell[1:] + 1))
        cell = np.minimum.accumulate(new - ramp) + ramp
    return int(cell.min())


def test_long_items_count_as_wholes():
    """A quote of a part isn't the item; the whole is, with edits up to a tenth of it, wherever they fall."""
    r, words = random.Random(13), vocabulary(2)
    long = prose(r, words, 2500)
    assert len(long) > 10_000
    index = d.Index.of([(1, long), (2, prose(r, words, 40))])
    texts = [long, "x " + edited(r, long, int(0.05 * len(long))) + " y", prose(r, words, 500), prose(r, words, 50) + long[3000:6000] + prose(r, words, 50), long[:4000] + prose(r, words, 300) + long[4000:], long * 2]
    got = d.matches(index, pa.array(texts)).tolist()
    assert sorted(a for a, *_ in got) == [0, 1, 5, 5] and {int(index.ids[0, b]) for _, b, *_ in got} == {1}
    assert [(a, b, c) for r_, _, a, b, c in got if r_ == 0] == [(0, len(long.encode()), 0)]
    assert sum(b - a for r_, _, a, b, _ in got if r_ == 1) > 0.95 * len(long)


def test_long_items_against_edit_distance():
    r, words = random.Random(14), vocabulary(3)
    for n in (230, 300, 420, 700):
        item = norm(prose(r, words, n)).strip()
        budget = int(d.EDITS * len(item))
        assert len(item) > d.PART
        index, text = d.Index.of([(1, item.decode())]), []
        for share in (0, 0.5, 0.9, 1.0, 1.1, 1.5):
            text.append(prose(r, words, 30) + " " + edited(r, item.decode(), int(share * budget)) + " " + prose(r, words, 30))
        for hole in (0.05, 0.09, 0.11, 0.2, 0.6):  # one stretch lost, or foreign words put in
            k = int(hole * len(item))
            text += [item[: len(item) // 3].decode("utf-8", "ignore") + item[len(item) // 3 + k :].decode("utf-8", "ignore"), item[:600].decode("utf-8", "ignore") + "\u00a0" * (k // 2) + item[600:].decode("utf-8", "ignore")]
        found = {int(h[0]): int(h[4]) for h in d.matches(index, pa.array(text))}
        for i, t in enumerate(text):
            fewest = fewest_edits(item, norm(t))
            assert (i in found) == (fewest <= budget), (n, i, fewest, budget)
            assert i not in found or found[i] == fewest


def test_null_item_ids_and_no_items(spark):
    docs = spark.createDataFrame([(1, "say a question of this benchmark, then stop"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a question of this benchmark")], "item_id long, text string")
    assert [tuple(x) for x in d.contaminated_regions(docs, bench).collect()] == [(1, None, 4, 32, 0)]
    assert d.contaminated_regions(docs, bench.where("false")).count() == 0 and docs.where(d.is_clean(bench.where("false"), docs["text"])).count() == 2
