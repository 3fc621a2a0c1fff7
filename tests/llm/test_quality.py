import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from wordmaker import prose, vocabulary

from tessera.llm import quality


def noisy(r, words, n):
    return r.choice([" ".join(w.upper() + "!!" for w in r.choices(words, k=n)), " | ".join(r.choices(words, k=n)), " ".join([r.choice(words)] * n)])


def corpus(spark, n=400):
    r, words = random.Random(4), vocabulary(3)
    rows = [(i, prose(r, words, r.randint(20, 200)) if i % 5 else noisy(r, words, r.randint(20, 200))) for i in range(n)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, n, 2)] + [(5, None, 0), (4, 1, 0), (4, 1, 1), (9999, 0, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_of_rows_held_out(spark):
    docs, labels = corpus(spark)
    stats = quality.document_statistics(docs)
    out = {r["doc_id"]: r for r in quality.score_statistics(stats, quality.fit(stats, labels)).collect()}
    held = [r for r in out.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in out if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 > 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(spark)
    stats = quality.document_statistics(docs)
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(stats, labels), quality.fit(stats, wrong)
    assert np.allclose(a.mean, b.mean) and np.allclose(a.factor, b.factor)


def test_moments_are_those_of_numpy(spark):
    docs, labels = corpus(spark, 60)
    rows = quality.document_statistics(docs).collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([r["doc_id"] % 2 for r in rows])
    got = quality.moments_of(spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x, strict=True)], "y int, x array<double>").repartition(3))
    for c in (0, 1):
        own = x[y == c]
        assert got[c][0] == len(own) and np.allclose(got[c][1], own.sum(0)) and np.allclose(got[c][2], own.T @ own)


def test_statistics_do_not_depend_on_neighbours():
    rows = ["One TWO two two!", None, "", "a|b", "x" * 3000, " \n ", "é É 12"]
    together = quality.statistics(pa.array(rows, pa.string()))
    assert np.isfinite(together).all() and together.shape == (7, len(quality.FEATURES))
    for i, t in enumerate(rows):
        assert np.allclose(together[i], quality.statistics(pa.array([t], pa.string()))[0])


def test_edge_rows_and_empty_labels(spark, edge, edge_rows, none):
    labels = spark.createDataFrame([(10, 1, 0), (20, 0, 0), (21, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality.document_statistics(edge)
    for some in (labels, labels.where("quality = 1"), labels.where("false")):
        model = quality.fit(stats, some)
        assert quality.score_statistics(stats, model).count() == len(edge_rows)
        kept = edge.withColumn("q", quality.quality_score(model, F.col("text")))
        assert kept.where("q is null or q < 0 or q > 1").count() == 0 and kept.count() == len(edge_rows)
    assert quality.document_statistics(none).count() == 0


def test_scores_against_a_plain_density():
    """Shrunken covariances, their inverse and determinant, and the two densities, each written out."""
    r = np.random.default_rng(7)
    d = len(quality.FEATURES)
    x = {0: r.normal(0, 1, (300, d)) @ r.normal(0, 1, (d, d)), 1: r.normal(0.5, 1, (500, d)) @ r.normal(0, 0.5, (d, d))}
    moments = {c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}
    model = quality.solve(moments, shrink=0.2, ridge=0.01)
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x.values()) / (800 - 2)
    test = np.abs(r.normal(0, 1, (40, d)))
    logs = []
    for c in (0, 1):
        cov = 0.8 * np.cov(x[c].T) + 0.2 * pooled
        cov = 0.99 * cov + (0.01 * np.trace(cov) / d + 1e-6) * np.eye(d)
        gap = test - x[c].mean(0)
        logs.append([np.log(len(x[c]) / 800) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * g @ np.linalg.inv(cov) @ g for g in gap])
    prior = np.log(501 / 301)
    words = np.expm1(test[:, 1])
    want = 1 / (1 + np.exp(-np.clip(prior + (np.array(logs[1]) - np.array(logs[0]) - prior) / 4 * words / (words + quality.SHORT), -40, 40)))
    assert np.allclose(model.score(test), want, atol=1e-6)


def test_fit_of_texts_is_the_fit_of_statistics(spark, edge):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 80)] + [(None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = quality.fit(quality.document_statistics(edge), labels), quality.fit_texts(edge, labels)
    assert np.allclose(a.mean, b.mean) and np.allclose(a.factor, b.factor)
    few = quality.fit_texts(edge, labels, most=5)
    assert not np.allclose(few.mean, b.mean)
