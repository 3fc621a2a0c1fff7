"""Recency-weighted ownership, bus factor and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import ancestors, parent_prefix
from tessera.operators.history import reachable

HALF_LIFE_DAYS, SHARE, INACTIVE_DAYS = 90.0, 0.70, 180


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400e6)


def ownership(commit_files: DataFrame, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(path_prefix, author_id, score, last_touched_at): changed lines halved every ``half_life`` days; rows without weight go."""
    age = F.greatest(F.lit(0.0), age_days(F.col("committed_at"), as_of))
    weight = (F.col("additions") + F.col("deletions")) * F.exp(-F.log(F.lit(2.0)) / half_life * age)
    rows = commit_files.where(F.col("author_id").isNotNull()).select(parent_prefix(F.col("path")).alias("path_prefix"), "author_id", "committed_at", weight.alias("w"))
    return rows.where("w > 0").groupBy("path_prefix", "author_id").agg(F.sum("w").alias("score"), F.max("committed_at").alias("last_touched_at"))


def bus_factor(owned: DataFrame, last_seen: DataFrame, as_of: Column, share: float = SHARE, inactive_days: int = INACTIVE_DAYS) -> DataFrame:
    """Prefixes whose top author (ties: least id) holds at least ``share``, and whether they have gone quiet."""
    top = owned.groupBy("path_prefix").agg(F.sum("score").alias("total"), F.min(F.struct((-F.col("score")).alias("s"), "author_id", "last_touched_at")).alias("top"))
    rows = top.where(F.col("total") > 0).select("path_prefix", F.col("top.author_id").alias("author_id"), (-F.col("top.s") / F.col("total")).alias("share"), F.col("top.last_touched_at").alias("touched"))
    seen = F.coalesce("last_seen_at", "touched")
    rows = rows.where(F.col("share") >= share).join(last_seen.select("author_id", "last_seen_at"), "author_id", "left")
    return rows.select("path_prefix", "author_id", "share", (age_days(seen, as_of) > inactive_days).alias("inactive"))


def contributions(authors: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits of every author, none included."""
    return authors.join(commits.select("author_id", "sha"), "author_id", "left").groupBy("author_id").agg(F.count("sha").alias("commits"))


def share_of_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(key)))


def top_prefixes(owned: DataFrame, per_prefix: int = 5, prefixes: int = 12) -> DataFrame:
    """Top authors of the prefixes with most score."""
    best = owned.groupBy("path_prefix").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "path_prefix").limit(prefixes)
    rank = F.row_number().over(Window.partitionBy("path_prefix").orderBy(F.desc("score"), "author_id"))
    return owned.join(F.broadcast(best), "path_prefix").withColumn("rank", rank).where(F.col("rank") <= per_prefix).select("path_prefix", "author_id", "score", "total", "rank")


def who_owns(paths: DataFrame, owned: DataFrame, limit: int = 10) -> DataFrame:
    """Owners of each path by its longest owned prefix, with their share of it."""
    asked = paths.select("path", F.posexplode(ancestors(parent_prefix(F.col("path")))).alias("up", "path_prefix"))
    met = asked.join(owned, "path_prefix")
    nearest = met.withColumn("best", F.min("up").over(Window.partitionBy("path"))).where("up = best")
    shared = nearest.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("path")))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "author_id"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= limit).select("path", "path_prefix", "author_id", "share", "rank")


def git_log(commit_files: DataFrame, path: str) -> DataFrame:
    """Commits that touch a path or anything below it."""
    return commit_files.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")) if path not in ("", ".") else commit_files


def link_pull_requests(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """pr_number of each commit: by merge sha, else by the first number its message names that is a pull request."""
    from tessera.functions.text import pr_numbers

    merged = pulls.where("merge_commit_sha is not null").groupBy("merge_commit_sha").agg(F.min("number").alias("merged"))
    out = commits.join(merged, commits["sha"] == merged["merge_commit_sha"], "left").withColumn("named", F.get(pr_numbers(F.col("message")), F.lit(0)))
    known = pulls.select(F.col("number").alias("known")).distinct()
    return out.join(known, out["named"] == known["known"], "left").select(*[out[c] for c in commits.columns], F.coalesce("merged", "known").alias("pr_number"))


def commit_walk(commits: DataFrame, known: DataFrame, limit: int | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Commits (sha, committed_at) newest first without those known, at most ``limit``; with ``heads`` (sha) only what they reach over ``parents``."""
    if heads is not None:
        commits = commits.join(reachable(commits, heads), "sha", "left_semi")
    rows = commits.join(known.select("sha").distinct(), "sha", "left_anti").orderBy(F.desc("committed_at"), "sha")
    return rows.limit(limit) if limit else rows


def file_changes(diffs: DataFrame) -> DataFrame:
    """(sha, path, old_path, additions, deletions) of diffs (sha, parent, old_path, new_path, additions, deletions): against the first parent only; a rename is one change of its new path."""
    path = F.coalesce("new_path", "old_path")
    rows = diffs.where((F.coalesce("parent", F.lit(0)) == 0) & path.isNotNull())
    moved = F.when(F.col("new_path").isNotNull() & (F.col("old_path") != F.col("new_path")), F.col("old_path"))
    return rows.groupBy("sha", path.alias("path")).agg(F.max(moved).alias("old_path"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def commit_rows(changes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Changes (sha, file_id, additions, deletions) with their commit (sha, author_id, committed_at) and file (file_id, path); commits without an author are left out."""
    met = changes.join(commits.where("author_id is not null").select("sha", "author_id", "committed_at"), "sha").join(files.select("file_id", "path"), "file_id")
    return met.select("path", "author_id", "additions", "deletions", "committed_at", "sha")


def with_authors(owned: DataFrame, authors: DataFrame) -> DataFrame:
    """Ownership rows with the author's name (author_id, name); unknown authors are left out."""
    return owned.join(authors.select("author_id", F.col("name").alias("author_name")), "author_id")


def why_here(commits: DataFrame, authors: DataFrame, pulls: DataFrame) -> DataFrame:
    """Commits (sha, author_id, message) with author name and the pull request they came by; either may be null."""
    named = commits.join(authors.select("author_id", F.col("name").alias("author_name")), "author_id", "left")
    titles = pulls.groupBy(F.col("number").alias("pr_number")).agg(F.min("title").alias("pr_title"))
    return link_pull_requests(named, pulls).join(titles, "pr_number", "left")
