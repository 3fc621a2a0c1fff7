"""Change detection, reuse and keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import normalize_path


def change_detection(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) added, changed, deleted or unchanged, by content hash."""
    b, a = before.select("path", F.col("sha").alias("old")), after.select("path", F.col("sha").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return b.join(a, "path", "full_outer").select("path", status.alias("status"))


def content_hash(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")))


def reusable(old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """(path, reuse): whether a file's set of chunk hashes is what it was."""
    of = lambda df, name: df.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("sha")), ",").alias(name))
    return of(new_chunks, "new").join(of(old_chunks, "old"), "path", "left").select("path", F.coalesce(F.col("new") == F.col("old"), F.lit(False)).alias("reuse"))


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old and new rows, the newest of each key."""
    return latest_per_key(old.unionByName(new), keys, order)


def push_paths(pushes: DataFrame, default_branch: str = "main") -> DataFrame:
    """(delivery_id, paths): sorted distinct changed paths of pushes to the default branch."""
    parts = F.flatten(F.transform("commits", lambda c: F.concat(F.coalesce(c["added"], F.array()), F.coalesce(c["modified"], F.array()), F.coalesce(c["removed"], F.array()))))
    rows = pushes.where(F.col("ref") == f"refs/heads/{default_branch}")
    return rows.select("delivery_id", F.array_sort(F.array_distinct(F.transform(parts, lambda p: normalize_path(p)))).alias("paths"))


def patch_edges(edges: DataFrame, changed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges with those of changed files replaced."""
    return edges.join(changed.select(F.col("path").alias("src_path")).distinct(), "src_path", "left_anti").unionByName(resolved)


def freshness(repos: DataFrame) -> DataFrame:
    return repos.select("repo_id", F.coalesce((F.col("head") == F.col("last_indexed")), F.lit(False)).alias("fresh"))
