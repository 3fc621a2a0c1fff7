import random
import re

from wordmaker import prose, vocabulary

from tessera.llm import units


def plain(rows, least, run):
    """Removed (doc, start, end), and kept first occurrences of repeated units, by a direct reading of the rule."""
    seen, words_of = {}, {}
    for k, (i, t) in enumerate(rows):
        t = t or ""
        words_of[k] = every = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        place = {a: x for x, (a, _) in enumerate(every)}
        for m in re.finditer(r"[^\n]+", t):
            words = list(re.finditer(r"[^\x20\x09-\x0D]+", m.group()))
            groups, now = [], []
            for w in words:
                now.append(w)
                if w.group()[-1] in ".!?":
                    groups.append(now)
                    now = []
            groups += [now] if now else []
            stretches = cut(words)
            named = [words] + (groups if len(groups) > 1 else []) + [g for g in stretches if len(stretches) > 1 and not (len(groups) > 1 and g in groups)]
            for g in named:
                if len(g) >= least:
                    norm = re.sub("[A-Z]", lambda x: x.group().lower(), " ".join(w.group() for w in g))
                    a = m.start() + g[0].start()
                    seen.setdefault(norm, []).append(((i if i is not None else 2**63, len(t[:a].encode())), k, place[a], place[a] + len(g)))
    again, own, firsts = {}, {}, set()
    for found in seen.values():
        if len(found) > 1:
            first = min(found)[0]
            for rank, k, a, b in found:
                (own if rank == first else again).setdefault(k, set()).update(range(a, b))
                if rank == first:
                    firsts.add((rows[k][0], words_of[k][a][0], words_of[k][b - 1][1]))
    out = set()
    for k, (i, _) in enumerate(rows):
        gone = set()
        for first, last in islands(again.get(k, ())):
            gone |= set(range(first, last + 1)) if last - first + 1 >= run else set()
        out |= {(i, words_of[k][a][0], words_of[k][b][1]) for a, b in islands(gone - own.get(k, set()))}
    return out, firsts


def islands(places):
    out = []
    for x in sorted(places):
        if out and x == out[-1][1] + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return out


def cut(words):
    """Words of a line in stretches, by a direct reading of the rule."""
    low = [re.sub("[A-Z]", lambda x: x.group().lower(), w.group()).encode() for w in words]
    own = [len(w) * 31 + w[0] * 7 + w[-1] * 13 for w in low] + [0]
    mark = [(own[k] * 17 + own[k + 1] * 29) % 1009 for k in range(len(words))]
    out = []
    for k, w in enumerate(words):
        if k == 0 or (all(mark[k] < x for x in mark[max(0, k - units.REACH) : k]) and all(mark[k] <= x for x in mark[k + 1 : k + 1 + units.REACH])):
            out.append([])
        out[-1].append(w)
    return out


def test_lines_and_sentences_against_a_plain_reading(spark, edge_rows):
    shared = "a passage of quite a few words that several documents hold."
    rows = [(i, t) for i, t, *_ in edge_rows if i != 11] + [(200, f"Start here.\n{shared}\nthe end"), (201, f"other words {shared} Another sentence of more than six words follows."), (202, f"lead. {shared.upper()} tail of it"), (203, "Another sentence of more than six words follows.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["start"], r["end"]) for r in units.repeated_units(df).collect()}
    assert plain(rows, units.MIN_WORDS, units.MIN_RUN)[0] == got
    for least, run in ((1, 1), (3, 8)):
        found = {(r["doc_id"], r["start"], r["end"]) for r in units.repeated_units(df, least, min_run=run).collect()}
        want, firsts = plain(rows, least, run)
        assert found == want and len(want) > 4
        # What a removal points to is whole: no first occurrence of a repeated unit is cut.
        assert not any(i == j and a < f and s < b for i, a, b in found for j, s, f in firsts)


def test_a_passage_inside_lines_is_found(spark):
    r, words = random.Random(2), vocabulary(7)
    passage = " ".join(r.choices(words, k=55))
    rows = [(i, prose(r, words, 40) + " " + passage + " " + prose(r, words, 40)) for i in range(20)] + [(100 + i, prose(r, words, 100)) for i in range(20)]
    got = {}
    for x in units.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x["doc_id"]] = got.get(x["doc_id"], 0) + x["end"] - x["start"]
    assert set(got) == set(range(1, 20)) and min(got.values()) > 0.6 * len(passage)


def test_common_lines_stay_and_passages_go(spark):
    """Boilerplate of a few words in otherwise unlike documents is left alone; planted passages at random places are found."""
    r, words = random.Random(12), vocabulary(8)
    lines = [" ".join(r.choices(words, k=r.randint(6, 14))) for _ in range(5)]
    passages = [" ".join(r.choices(words, k=r.randint(51, 70))) for _ in range(40)]
    rows = [(i, "\n".join([prose(r, words, 60), r.choice(lines), prose(r, words, 60)])) for i in range(100)]
    at = {}
    for k, p in enumerate(passages):
        for i in (1000 + 2 * k, 1001 + 2 * k):
            body = prose(r, words, 120).split(" ")
            cut_at = r.randrange(len(body))
            rows.append((i, " ".join([*body[:cut_at], p, *body[cut_at:]])))
        at[1001 + 2 * k] = len(p)
    got = {}
    for x in units.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x["doc_id"]] = got.get(x["doc_id"], 0) + x["end"] - x["start"]
    assert not set(got) - set(at) and len(got) >= 0.95 * len(at)
    assert sum(got.values()) >= 0.7 * sum(at.values())


def test_cleaned_texts_and_offsets(spark, edge, edge_rows, none):
    out = units.repeated_units(edge, with_text=True).collect()
    assert len(out) == len(edge_rows)
    texts = {}
    for i, t, *_ in edge_rows:
        texts.setdefault(i, []).append(t or "")
    for r in out:
        options = []
        for t in texts[r["doc_id"]]:
            left, kept = 0, []
            for s in r["removed"]:
                kept.append(t[left : s["start"]])
                left = s["end"]
            options.append("".join(kept) + t[left:])
        assert r["text"] in options
    assert units.repeated_units(none).count() == 0 and units.repeated_units(none, with_text=True).count() == 0
