"""Readers, tenant views and sinks."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.paths import is_scanned, is_source
from tessera.sources import tree
from tessera.sources.mergetable import MergeTable

logger = logging.getLogger(__name__)
MOST_ENTRIES, MOST_LINES, MOST_GLOB, BINARY_SNIFF = 500, 400, 300, 8192
#: A file over this many bytes is only read by a window of lines.
WINDOW_FROM = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark: SparkSession, root: str, manifests: bool = False) -> DataFrame:
    """(path, length, text) of a tree's source files; on demand its manifests, environment examples, infrastructure and workflow files too.

    Skipped folders aren't entered (``sources.tree``). A store that only Spark opens
    is listed by Spark instead, which leaves out names that begin with a dot or an
    underscore and opens what it then leaves out by path.
    """
    if tree.opens(root):
        return tree.read_tree(spark, root, "repository" if manifests else "source")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/", "")
    rows = raw.select(path.alias("path"), "content", "length")
    return rows.where(is_scanned(F.col("path")) if manifests else is_source(F.col("path"))).select("path", "length", F.decode("content", "UTF-8").alias("text"))


def list_dir(files: DataFrame, folder: str, most: int = MOST_ENTRIES) -> DataFrame:
    """(name, is_dir): folders first, then files, by lower-case name."""
    lead = "" if folder in ("", ".") else folder.rstrip("/") + "/"
    rest = F.expr(f"substring(path, {len(lead) + 1})")
    rows = files.where(F.col("path").startswith(lead)).select(F.regexp_extract(rest, "^([^/]+)", 1).alias("name"), rest.contains("/").alias("is_dir")).distinct()
    return rows.orderBy(F.desc("is_dir"), F.lower("name"), "name").limit(most)


def read_file(files: DataFrame, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines [start, end] of a file, at most MOST_LINES; a file with a NUL in its head gives none, one over WINDOW_FROM bytes none without a window."""
    if start is None and end is None:
        files = files.where(F.octet_length(F.coalesce("text", F.lit(""))) <= WINDOW_FROM)
    start = start or 1
    stop = min(end or start + MOST_LINES - 1, start + MOST_LINES - 1)
    rows = files.where((F.col("path") == path) & ~F.substring("text", 1, BINARY_SNIFF).contains("\0"))
    return rows.select(F.posexplode(F.split("text", "\n")).alias("at", "text")).select((F.col("at") + 1).alias("line"), "text").where(F.col("line").between(start, stop))


def glob_files(files: DataFrame, pattern: str, most: int = MOST_GLOB) -> DataFrame:
    """Paths that match a glob (**: any depth, *: within a folder, ?: one character)."""
    out = ""
    i = 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "/_" else c), i + 1
    return files.where(F.col("path").rlike("^" + out + "$")).select("path").orderBy("path").limit(most)


class TenantView:
    """Tables seen by one tenant: every read carries the predicate, every write is checked against it."""

    def __init__(self, tenant: str, column: str = "org_id") -> None:
        self.tenant, self.column = tenant, column

    def read(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.column) == self.tenant)

    def check(self, df: DataFrame) -> DataFrame:
        """The rows, failing at run time on one of another tenant."""
        ok = F.col(self.column) == F.lit(self.tenant)
        return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("row of another tenant")).cast("boolean")))


def replace_keys(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions of ``keys`` that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], newest: Column, version: str) -> str:
    """Merge rows by key into a versioned table; returns the new version's path. The old version stays until it is dropped, so a failed write loses nothing."""
    try:
        old = spark.read.parquet(path)
        both = old.unionByName(new, allowMissingColumns=True)
    except Exception as missing:  # noqa: BLE001  a first write has nothing to merge with
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        both = new
    out = f"{path.rstrip('/')}@{version}"
    both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(newest))).where("_n = 1").drop("_n").write.mode("overwrite").parquet(out)
    return out


def publish(pages: DataFrame, checks: DataFrame, staging: str, live: str) -> bool:
    """Write a version under ``staging``; only if no check failed does the pointer under ``live`` name it. Readers see the old version or the new one, and a failed write leaves the old."""
    spark = pages.sparkSession
    version = f"{staging.rstrip('/')}/{uuid.uuid4().hex}"
    pages.write.mode("errorifexists").parquet(version)
    if not checks.where(~F.col("ok")).isEmpty():
        return False
    _point(spark, live, version)
    return True


def _point(spark: SparkSession, live: str, version: str) -> None:
    """Replace the pointer file by renaming a finished one over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{live.rstrip('/')}/CURRENT")
    fs = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    draft = jvm.org.apache.hadoop.fs.Path(f"{live.rstrip('/')}/CURRENT.{uuid.uuid4().hex}")
    plain = draft.getFileSystem(conf)
    plain.mkdirs(target.getParent())
    out = plain.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.rename(draft, target, overwrite)


def published(spark: SparkSession, live: str) -> DataFrame | None:
    """The published version; None before the first."""
    try:
        version = spark.read.text(f"{live.rstrip('/')}/CURRENT").first()[0]
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return spark.read.parquet(version)


def append_trace(df: DataFrame, path: str) -> bool:
    """Append a run's rows as JSON; a trace that can't be written is logged and lost, the run goes on."""
    try:
        df.write.mode("append").json(path)
    except Exception:  # noqa: BLE001
        logger.warning("trace not written to %s", path, exc_info=True)
        return False
    return True


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document of a report's rows."""
    report.coalesce(1).write.mode("overwrite").json(path)


class ResultCache:
    """Results by (revision, question): written once, read until they are older than ``ttl_days``; any failure counts as a miss."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: float = 7.0) -> None:
        self.spark, self.path, self.ttl_days = spark, path.rstrip("/"), ttl_days

    @staticmethod
    def key(revision: str, question: str) -> str:
        return f"{revision}-{hashlib.sha256(question.encode()).hexdigest()[:16]}"

    def get(self, revision: str, question: str) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/{self.key(revision, question)}")
            fresh = rows.where(F.col("cached_at") > F.current_timestamp() - F.expr(f"interval '{int(self.ttl_days * 86_400)}' second"))
            return None if fresh.isEmpty() and not rows.isEmpty() else fresh.drop("cached_at")
        except Exception:  # noqa: BLE001
            return None

    def put(self, revision: str, question: str, rows: DataFrame) -> bool:
        try:
            rows.withColumn("cached_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.path}/{self.key(revision, question)}")
        except Exception:  # noqa: BLE001
            logger.warning("result not cached", exc_info=True)
            return False
        return True


class RunLedger:
    """Runs as appended rows (run_id, trigger, status, stats, error, at); the newest row of a run is its state."""

    SCHEMA = "run_id string, trigger string, status string, stats string, error string, at timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _add(self, run_id: str, trigger: str, status: str, stats: dict, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(run_id, trigger, status, json.dumps(stats, default=str), error)], "run_id string, trigger string, status string, stats string, error string")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def run(self, trigger: str, stages: list[tuple[str, Callable[[], object]]]) -> dict:
        """Run the stages in turn under a ledger row; never raises, and what earlier stages wrote stays where a later one fails."""
        run_id, stats = uuid.uuid4().hex, {}
        self._add(run_id, trigger, "running", stats)
        try:
            for name, stage in stages:
                stats[name] = stage()
        except Exception as e:  # noqa: BLE001
            self._add(run_id, trigger, "error", stats, str(e)[:2000])
            return {"ok": False, "run_id": run_id, "error": str(e), "stats": stats}
        self._add(run_id, trigger, "success", stats)
        return {"ok": True, "run_id": run_id, "stats": stats}

    def states(self) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = F.max_by(F.struct("trigger", "status", "stats", "error", "at"), F.struct("at", (F.col("status") != "running").alias("done"))).alias("s")
        return rows.groupBy("run_id").agg(last).select("run_id", "s.*")


def ingest_history(spark: SparkSession, folder: str, commits: DataFrame, changes: DataFrame, number: int) -> dict[str, DataFrame]:
    """Commits not seen before, then their authors and files by key, then their changes: the tables by name, as they are after the batch.

    ``commits``: sha, author_id, author_name, committed_at. ``changes``: sha, path,
    additions, deletions. Each batch, numbered upwards, writes its own rows alone.
    """
    of = {"authors": ["author_id"], "files": ["path"], "commits": ["sha"], "commit_files": ["sha", "path"]}
    stored = {name: MergeTable(spark, f"{folder}/{name}", keys, "committed_at") for name, keys in of.items()}
    seen = stored["commits"].read()
    new = commits if seen is None else commits.join(seen.select("sha"), "sha", "left_anti")
    touched = changes.join(new.select("sha", "committed_at"), "sha")
    rows = {"authors": new.select("author_id", "author_name", "committed_at"), "files": touched.select("path", "committed_at", "sha"), "commit_files": touched, "commits": new}
    for name, batch in rows.items():  # commits last: a batch that fails before is taken up whole when it runs again
        stored[name].write(batch, number)
    return {name: stored[name].read() for name in of}


# -- listings ---------------------------------------------------------------------------------------------------------


def listing(rows: DataFrame, order: list[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page of rows in order."""
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def list_pages(pages: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    return listing(pages, [F.col("type"), F.col("title"), F.col("slug")], page, size)


def list_repositories(repos: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    return listing(repos, [F.col("full_name")], page, size)


def list_conversations(conversations: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    return listing(conversations, [F.desc("updated_at"), F.col("conv_id")], page, size)


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of a JSON file; an unknown category fails."""
    known = ("locate", "flow", "exact_string", "history", "unanswerable")
    rows = spark.read.option("multiLine", True).json(path)
    return rows.where(F.when(F.col("category").isin(*known), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown category "), "category")).cast("boolean")))


