import random
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from wordmaker import prose, vocabulary

from tessera.llm import decontaminate, jaccard, queries, sharding

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def test_stages_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        if name == "near_duplicates":
            assert jaccard.jaccard_components(docs).where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated_regions(docs, bench).count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = spark.read.parquet(str(tmp_path / "quality")).join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.97 * labels.where("quality = 1").count() and kept.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
    run = corpus_pipeline.run(spark, DATA)
    assert set(sharding.ADDED) < set(run.columns) and run.count() == counts[-1]


def test_stages_with_edge_rows(spark, edge, tmp_path):
    base = edge.select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("shard"))
    spark.createDataFrame([(10, 1, 0), (20, 1, 0), (21, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such text in any of the documents of this table at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (base, base.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert not queries.QUERIES[name](spark, DATA).isEmpty()


def test_columns_keep_their_values_through_all_stages(spark, tmp_path):
    """Names that the operators use themselves, and rows without an id or with a common one."""
    r, words = random.Random(8), vocabulary()
    rows = [(None if i % 7 == 3 else i // 2 if i % 5 == 0 else i, prose(r, words, 60), "en", f"s{i % 3}" if i % 4 else None, i, -i, i * 10, f"c{i}", f"k{i}", f"i{i}", 100 + i, f"v{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Size long, target long, _copy string, _key string, _id string, shard int, own0 string")
    spark.createDataFrame([(20, 1, 0), (21, 1, 0), (22, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such text in any of the documents of this table at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    of = {x[1]: x for x in rows}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "Size", "target", "_copy", "_key", "_id", "shard", "own0"]
            assert all(tuple(x) == of[x["text"]] for x in docs.collect()) and docs.count() > 20
    got = docs.collect()
    assert all((x["own_Size"], x["target"], x["_copy"], x["_key"], x["_id"], x["own_shard"], x["own0"]) == of[x["text"]][5:] for x in got) and {x["shard"] for x in got} <= set(range(24))
