"""Incremental maintenance as Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.paths import parent_prefix
from tessera.operators import extract
from tessera.operators.incremental import push_paths
from tessera.operators.ownership import HALF_LIFE_DAYS, age_days
from tessera.sources.mergetable import MergeTable
from tessera.sources.scratch import Scratch

PUSH = "delivery_id string, ref string, after string, repository_id long, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"
#: More changed paths than this ask for a full rebuild.
FULL_FROM = 500


def decayed_sums(commit_files: DataFrame, origin: str, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Per (prefix, author): sum of changed lines grown from ``origin``, and last touch. Any order of arrival gives the same sums."""
    grown = (F.col("additions") + F.col("deletions")) * F.exp(F.log(F.lit(2.0)) / half_life * -age_days(F.col("committed_at"), F.lit(origin).cast("timestamp")))
    rows = commit_files.where("author_id is not null and additions + deletions > 0").select(parent_prefix(F.col("path")).alias("path_prefix"), "author_id", "committed_at", grown.alias("w"))
    return rows.groupBy("path_prefix", "author_id").agg(F.sum("w").alias("grown"), F.max("committed_at").alias("last_touched_at"))


def scores_at(sums: DataFrame, origin: str, as_of: str, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Ownership as of a time no earlier than any commit."""
    shrink = F.exp(-F.log(F.lit(2.0)) / half_life * age_days(F.lit(origin).cast("timestamp"), F.lit(as_of).cast("timestamp")))
    return sums.select("path_prefix", "author_id", (F.col("grown") * shrink).alias("score"), "last_touched_at")


def ownership_stream_once(spark: SparkSession, commit_files: DataFrame, as_of: str) -> DataFrame:
    """Run the streaming form over what there is now: files in, one running aggregate, the last state out."""
    scratch = Scratch(spark, "ownership-stream")
    commit_files.write.parquet(scratch.path("in"))
    stream = spark.readStream.schema(commit_files.schema).option("maxFilesPerTrigger", 4).parquet(scratch.path("in"))
    out = scratch.path("state")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n % 2}")
        batch.sparkSession.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{out}/last")

    query = decayed_sums(stream, as_of).writeStream.outputMode("complete").option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{out}/last").first()[0]
    return scores_at(spark.read.parquet(f"{out}/{last % 2}"), as_of, as_of)


def push_stream(spark: SparkSession, folder: str, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, default_branch: str = "main") -> StreamingQuery:
    """Pushes as JSON files: each delivery once; ``handle(changed, full, n)`` gets changed (repository_id, path) rows and the repositories that ask for a full rebuild."""
    pushes = spark.readStream.schema(PUSH + ", received_at timestamp").json(folder).withWatermark("received_at", "1 hour").dropDuplicatesWithinWatermark(["delivery_id"])

    def run(batch: DataFrame, n: int) -> None:
        paths = batch.join(push_paths(batch, default_branch), "delivery_id").select("repository_id", "paths")
        full = paths.where(F.size("paths") >= FULL_FROM).select("repository_id").distinct()
        changed = paths.where(F.size("paths") < FULL_FROM).select("repository_id", F.explode("paths").alias("path")).distinct()
        handle(changed, full, n)

    return pushes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Newest event of each key, as a running aggregate."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("s")).select(*keys, "s.*")


# -- deliveries ---------------------------------------------------------------------------------------------------------

# Deliveries that are handled.
EVENTS = ("installation", "installation_repositories", "push", "pull_request", "pull_request_review")


def hmac_sha256(body: Column, secret: str) -> Column:
    """Lower-case hex HMAC of a text, with built-in functions only."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def verified(deliveries: DataFrame, secret: str | None) -> DataFrame:
    """Deliveries (event, signature, body) whose ``sha256=...`` signature holds; all of them without a secret."""
    return deliveries.where(F.coalesce(F.lower("signature"), F.lit("")) == F.concat(F.lit("sha256="), hmac_sha256(F.col("body"), secret))) if secret else deliveries


def route_deliveries(deliveries: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], secret: str | None = None) -> dict[str, int]:
    """Hand each kind of verified delivery to its handler; deliveries of other kinds are accepted and left. Returns rows by kind."""
    good = verified(deliveries, secret).where(F.col("event").isin(*EVENTS)).dropDuplicates(["delivery_id"])
    counts = {r[0]: r[1] for r in good.groupBy("event").count().collect()}
    for event, handle in handlers.items():
        if counts.get(event):
            handle(good.where(F.col("event") == event))
    return counts


def delivery_stream(spark: SparkSession, folder: str, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str, secret: str | None = None) -> StreamingQuery:
    """Deliveries as JSON files, verified and routed batch by batch."""
    rows = spark.readStream.schema("delivery_id string, event string, signature string, body string, received_at timestamp").json(folder)
    once = rows.withWatermark("received_at", "1 hour").dropDuplicatesWithinWatermark(["delivery_id"])
    return once.writeStream.foreachBatch(lambda batch, n: route_deliveries(batch, handlers, secret) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _reviews(spark: SparkSession, folder: str) -> MergeTable:
    return MergeTable(spark, folder, ["repo_id", "pr_id", "head_sha"], "created_at")


def review_sink(spark: SparkSession, reviews: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Reviews (repo_id, pr_id, head_sha, ..., created_at) merged by (repo_id, pr_id, head_sha): a batch writes its own rows alone, and one that runs again leaves the same rows, the newest of each."""
    table = _reviews(spark, folder)
    return reviews.writeStream.foreachBatch(lambda batch, n: table.write(batch, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_reviews(spark: SparkSession, folder: str) -> DataFrame | None:
    return _reviews(spark, folder).read()


def dismiss_latest(reviews: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Reviews with ``dismissed`` set on the newest of each (repo_id, pr_id) that a dismissal names."""
    newest = reviews.groupBy("repo_id", "pr_id").agg(F.max(F.struct("created_at", "head_sha")).alias("m")).join(dismissed.select("repo_id", "pr_id").distinct(), ["repo_id", "pr_id"])
    hit = newest.select("repo_id", "pr_id", F.col("m.head_sha").alias("head_sha"), F.lit(True).alias("hit"))
    met = reviews.join(hit, ["repo_id", "pr_id", "head_sha"], "left")
    return met.withColumn("dismissed", F.coalesce("dismissed", F.lit(False)) | F.coalesce("hit", F.lit(False))).drop("hit")


# -- incremental sync ---------------------------------------------------------------------------------------------------


def sync_files(files: DataFrame, changed: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The graph and chunks after a push: only changed files (path) are parsed and chunked again; edges from them, and edges into symbols that are gone, are linked again.

    From FULL_FROM changed paths on, everything is built anew. ``files`` is the tree
    after the push; a changed path that isn't there was deleted.
    """
    if changed.select("path").distinct().limit(FULL_FROM).count() >= FULL_FROM:
        new_symbols, new_edges = extract.repository_graph(files)
        return {"symbols": new_symbols, "edges": new_edges, "chunks": extract.chunk_files(files, new_symbols)}
    paths = F.broadcast(changed.select("path").distinct())
    touched = files.join(paths, "path", "left_semi")
    fresh = extract.extract_symbols(touched).withColumn("symbol_id", extract.symbol_id())
    kept = symbols.join(paths, "path", "left_anti")
    every = kept.unionByName(fresh.select(*kept.columns))
    # Files that call into a changed one may point to symbols that moved.
    moved = symbols.join(paths, "path", "left_semi").select(F.col("symbol_id").alias("dst_id"))
    callers = edges.join(moved, "dst_id", "left_semi").select("path").where("path is not null")
    importers = edges.where("kind = 'imports'").join(changed.select(F.col("path").alias("dst_name")), "dst_name", "left_semi").select("path")
    again = paths.unionByName(callers).unionByName(importers).distinct()
    linked = extract.link_files(files.join(F.broadcast(again), "path", "left_semi"), files, every)
    old = edges.join(again, "path", "left_anti")
    return {"symbols": every, "edges": old.unionByName(linked), "chunks": chunks.join(paths, "path", "left_anti").unionByName(extract.chunk_files(touched, fresh).select(*chunks.columns))}
