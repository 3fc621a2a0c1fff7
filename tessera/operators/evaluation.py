"""Retrieval and review scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import normalize_path
from tessera.functions.text import abstains


def recall_at_k(expected: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """(id, recall) of (id, path) against (id, path, rank): distinct normalised paths; 1 where nothing is expected (ids come from ``expected``, null path: none)."""
    want = expected.select("id", normalize_path(F.col("path")).alias("p"), F.col("path").isNotNull().alias("real")).distinct()
    top = retrieved.where(F.col("rank") <= k).select("id", normalize_path(F.col("path")).alias("p")).distinct().withColumn("hit", F.lit(1))
    met = want.join(top, ["id", "p"], "left")
    return met.groupBy("id").agg(F.coalesce(F.sum(F.when(F.col("real"), F.coalesce("hit", F.lit(0)))) / F.nullif(F.count_if(F.col("real")), F.lit(0)), F.lit(1.0)).alias("recall"))


def abstention(answers: DataFrame) -> DataFrame:
    return answers.select("answer_id", abstains(F.col("answer")).alias("abstains"))


def report(scores: DataFrame) -> DataFrame:
    """One row of rates over (category, recall, found, grounded, abstained): recall over locate, flow and exact_string if any, else over all."""
    main = F.avg(F.when(F.col("category").isin("locate", "flow", "exact_string"), F.col("recall")))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    zero = F.lit(0.0)
    return scores.agg(
        F.count("*").alias("n"),
        F.coalesce(main, F.avg("recall"), zero).alias("mean_recall"),
        F.coalesce(rate("grounded"), zero).alias("grounding_rate"),
        F.coalesce(rate("found"), zero).alias("string_match_rate"),
        F.coalesce(rate("abstained"), zero).alias("abstention_rate"),
        F.coalesce(1 - rate("abstained"), zero).alias("hallucination_rate"),
    )


def set_scores(items: DataFrame) -> DataFrame:
    """Precision, recall and items with a false positive over (expected, found) arrays."""
    both, extra = F.size(F.array_intersect("expected", "found")), F.size(F.array_except("found", "expected"))
    hit, found, want = F.sum(both), F.sum(F.size(F.array_distinct("found"))), F.sum(F.size(F.array_distinct("expected")))
    return items.agg(F.coalesce(hit / F.nullif(found, F.lit(0)), F.lit(1.0)).alias("precision"), F.coalesce(hit / F.nullif(want, F.lit(0)), F.lit(1.0)).alias("recall"), F.count_if(extra > 0).alias("false_positive_items"))
