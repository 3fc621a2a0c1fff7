import random
from pathlib import Path

import pytest

from tessera.sources import mergetable
from tessera.sources.mergetable import MergeTable

SCHEMA = "k int, part string, at long, v string, gone boolean"


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def plain(batches):
    """The newest row of each key; of equal times the later batch's."""
    have = {}
    for number, rows in batches:
        for k, part, at, v, gone in rows:
            key, order = (k, part), (at is not None, at or 0, number)
            if key not in have or order >= have[key][0]:
                have[key] = (order, v, gone)
    return sorted(((k, p, v) for (k, p), (_, v, gone) in have.items() if not gone), key=str)


def rows(table):
    return sorted(((r["k"], r["part"], r["v"]) for r in table.read().collect()), key=str)


@pytest.mark.parametrize("into_base", [0.5, 100.0, 0.0])
def test_reads_give_the_newest_row(spark, tmp_path, monkeypatch, into_base):
    monkeypatch.setattr(mergetable, "MOST_DELTAS", 3)
    monkeypatch.setattr(mergetable, "INTO_BASE", into_base)
    r, batches = random.Random(3), []
    table = MergeTable(spark, str(tmp_path / "t"), ["k", "part"], "at", "gone")
    assert table.read() is None
    for number in range(7):
        batch = {(k := r.choice([None, *range(12)]), p := r.choice("ab")): (k, p, r.choice([None, 5, 6, r.randrange(20)]), f"{number}-{i}", r.random() < 0.2) for i in range(r.choice([0, 1, 20]))}
        batches.append((number, list(batch.values())))
        assert table.write(spark.createDataFrame(list(batch.values()), SCHEMA), number)
        if table.read() is not None:
            assert rows(table) == plain(batches)
    before = rows(table)
    assert not table.write(spark.createDataFrame([(1, "a", 99, "late", False)], SCHEMA), 3) and rows(table) == before
    table.compact(True)
    assert rows(table) == before and table._manifest()["deltas"] == []
    assert table.vacuum() and rows(table) == before
    assert MergeTable(spark, str(tmp_path / "t"), ["k", "part"], "at", "gone").write(spark.createDataFrame([], SCHEMA), 7) and rows(table) == before


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    """Of a table of 200,000 rows, a batch of 50 rows writes some KB, and merging it writes its buckets."""
    path = str(tmp_path / "t")
    table = MergeTable(spark, path, ["k"], "at")
    table.write(spark.range(200_000).selectExpr("cast(id as int) as k", "0L as at", "sha2(cast(id as string), 256) as v"), 0)
    table.compact(True)
    table.vacuum()
    whole = size(path)
    assert whole > 5_000_000
    for number in range(1, 6):
        before = size(path)
        table.write(spark.range(50).selectExpr(f"cast(id * 7 + {number} as int) as k", f"{number}L as at", "'new' as v"), number)
        assert size(path) - before < whole / 50
    assert table.read().count() == 200_000 and table.read().where("v = 'new'").count() == len({i * 7 + n for i in range(50) for n in range(1, 6)})
    before = size(path)
    table.compact()  # the deltas among themselves: the base is far larger
    assert size(path) - before < whole / 50 and len(table._manifest()["deltas"]) == 1
    one = MergeTable(spark, path, ["k"], "at")
    one.write(spark.createDataFrame([(3, 9, "x")], "k int, at long, v string"), 9)
    before = size(path)
    one.vacuum()
    assert size(path) < before and one.read().where("k = 3").first()["v"] == "x"


def test_a_failed_batch_is_not_seen(spark, tmp_path, monkeypatch):
    table = MergeTable(spark, str(tmp_path / "t"), ["k"], "at")
    table.write(spark.createDataFrame([(1, 1, "a")], "k int, at long, v string"), 0)

    def fails(manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", fails)
        with pytest.raises(OSError, match="lost"):
            table.write(spark.createDataFrame([(1, 2, "b"), (2, 2, "c")], "k int, at long, v string"), 1)
    assert [r["v"] for r in table.read().collect()] == ["a"]
    table.write(spark.createDataFrame([(1, 2, "b")], "k int, at long, v string"), 1)
    assert [r["v"] for r in table.read().collect()] == ["b"]


def test_columns_that_come_later(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), ["k"], "at")
    table.write(spark.createDataFrame([(1, 1)], "k int, at long"), 0)
    table.write(spark.createDataFrame([(2, 1, "x")], "k int, at long, more string"), 1)
    assert sorted(map(tuple, table.read().select("k", "more").collect())) == [(1, None), (2, "x")]
