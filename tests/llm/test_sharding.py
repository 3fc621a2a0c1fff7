import random
import zlib
from collections import Counter

from tessera.llm import sharding


def test_every_row_once_in_even_shards(edge, edge_rows, none):
    for bucket in (1 << 24, 4096):
        got = sharding.external_shuffle(edge, shards=5, bucket_bytes=bucket).collect()
        assert len(got) == len(edge_rows)
        want = Counter((i, t, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows)
        assert Counter((r["doc_id"], r["text"], r["size"], r["text_crc32"]) for r in got) == want
        counts = Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
        for s in counts:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
        assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.external_shuffle(none).count() == 0


def test_reruns_agree_and_seeds_differ(edge):
    place = lambda df: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect())
    a = place(sharding.external_shuffle(edge, 4, bucket_bytes=4096))
    assert a == place(sharding.external_shuffle(edge.repartition(7), 4, bucket_bytes=4096))
    assert a != place(sharding.external_shuffle(edge, 4, seed=12, bucket_bytes=4096))


def test_order_is_well_mixed(spark):
    n = 4000
    df = spark.range(n).selectExpr("id as doc_id", "'t' as text")
    got = sorted(sharding.external_shuffle(df, 1, bucket_bytes=1 << 14).collect(), key=lambda r: r["slot"])
    order = [r["doc_id"] for r in got]
    assert sorted(order) == list(range(n))
    up = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert abs(up / n - 0.5) < 0.05
    first = sum(x < n / 2 for x in order[: n // 2])
    assert abs(first / (n / 2) - 0.5) < 0.06


def test_plan_has_no_python(edge):
    plan = sharding.external_shuffle(edge)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_written_shards(spark, edge, edge_rows, tmp_path):
    sharding.write_shards(sharding.external_shuffle(edge, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(edge_rows) and back.select("shard").distinct().count() == 3


def test_copies_of_a_row_spread_over_buckets_and_places(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 64)
    rows = [(7, "the same text", {"k": 1})] * 1000 + [(i, f"text {i}", None) for i in range(1000, 2000)] + [(None, None, {})] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>").repartition(4)
    got = sharding.external_shuffle(docs, 1, bucket_bytes=1 << 13).collect()
    assert Counter((r["doc_id"], r["text"], str(r["tags"])) for r in got) == Counter((i, t, str(m)) for i, t, m in rows)
    places = sorted(r["slot"] for r in got if r["doc_id"] == 7)
    assert sorted(r["slot"] for r in got) == list(range(2050))
    tenth = Counter(p * 10 // 2050 for p in places)
    assert len(tenth) == 10 and max(tenth.values()) < 160 and places[0] < 50 and places[-1] > 2000


def test_rows_that_differ_in_one_other_column_are_kept_apart(spark):
    docs = spark.createDataFrame([("a", "t", k % 3) for k in range(30)], "doc_id string, text string, n int")
    got = sharding.external_shuffle(docs, 4).collect()
    assert Counter((r["doc_id"], r["n"]) for r in got) == {("a", 0): 10, ("a", 1): 10, ("a", 2): 10}


def plain_shuffle(counts, seed):
    """An inside-out Fisher-Yates of each bucket."""
    r, out = random.Random(seed), []
    for n in counts:
        a = []
        for i in range(n):
            j = r.randrange(i + 1)
            a.append(i)
            a[i], a[j] = a[j], i
        out.append(a)
    return out


def test_places_are_a_permutation_of_each_bucket(spark):
    """As a plain shuffle by bucket: every bucket's rows keep a gapless run of places, in an order unlike that of their hashes."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text")
    got = sorted(sharding.external_shuffle(docs, 1, bucket_bytes=1 << 14).collect(), key=lambda r: r["slot"])
    again = sorted(sharding.external_shuffle(docs, 1, bucket_bytes=1 << 14, seed=12).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(3000)) and sum(a["doc_id"] == b["doc_id"] for a, b in zip(got, again, strict=True)) < 20
    for order in [[r["doc_id"] for r in got], *plain_shuffle([3000], 5)]:
        moved = sum(abs(x - k) for k, x in enumerate(order)) / 3000
        assert 900 < moved < 1100  # a third of the length in the mean
