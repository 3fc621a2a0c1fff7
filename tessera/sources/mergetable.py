"""Tables that are merged when they are read.

A batch of rows is written as a delta of its own, so it costs what it holds and not
what the table holds; a reader takes the newest row of each key over the base and
its deltas. Rows lie in folders by key bucket. When MOST_DELTAS have come together
they are merged: among themselves while they are small beside the base, else into
the base, of which only the buckets they touch are written again; so a row is
written some logarithm of the table's size times.

What a reader sees is one small manifest, replaced by renaming: a batch that fails
half-way isn't seen, and one that runs again replaces its own files. Batches are
numbered upwards, as Structured Streaming numbers them; a number that was merged is
passed over. One writer at a time.

Defined results: of equal ``newest`` the later batch's row counts, in a batch any
one of them by a hash of its columns; null keys are keys; columns that some batches
lack are null there; rows whose ``deleted`` column is true are gone, until a newer
row of their key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key buckets, deltas that are merged together, and the share of the base's rows from which they go into it.
BUCKETS, MOST_DELTAS, INTO_BASE = 32, 12, 0.5


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], newest: str, deleted: str | None = None) -> None:
        self.spark, self.path, self.keys, self.newest, self.deleted = spark, path.rstrip("/"), keys, newest, deleted

    # -- reading

    def _manifest(self) -> dict:
        """``base``: folder by bucket, with its rows; ``deltas``: folders with their rows and buckets, oldest first; ``last``: the number of the last batch."""
        try:
            return json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return {"base": {}, "deltas": [], "last": -1}

    def _parts(self, folders: dict[str, list[str] | None]) -> DataFrame | None:
        """Rows of folders, of some buckets each (None: all)."""
        out = None
        for folder, buckets in folders.items():
            at = f"{self.path}/{folder}"
            part = self.spark.read.option("basePath", at).parquet(*([at] if buckets is None else [f"{at}/_bucket={b}" for b in buckets]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _base(self, manifest: dict, of: list[str] | None = None) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for bucket, (folder, _) in manifest["base"].items():
            if of is None or bucket in of:
                found.setdefault(folder, []).append(bucket)
        return found

    def _newest(self, rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c not in ("_bucket", "_batch")]
        order = [F.desc_nulls_last(self.newest), F.desc("_batch"), F.xxhash64(*[F.to_json(F.struct(c)) for c in own])]
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket", *self.keys).orderBy(*order))).where("_n = 1").drop("_n")

    def read(self) -> DataFrame | None:
        """The newest row of each key; None before the first batch with rows."""
        manifest = self._manifest()
        rows = self._parts(self._base(manifest) | {d["folder"]: None for d in manifest["deltas"]})
        if rows is None:
            return None
        out = self._newest(rows) if manifest["deltas"] else rows
        if self.deleted and self.deleted in out.columns:
            out = out.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
        return out.drop("_bucket", "_batch")

    # -- writing

    def _store(self, rows: DataFrame, folder: str) -> dict[str, int]:
        """Write rows by bucket; the rows of each bucket that has some."""
        parts = max(1, min(BUCKETS, rows.sparkSession.sparkContext.defaultParallelism))
        rows.repartition(parts, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        try:
            written = self.spark.read.parquet(f"{self.path}/{folder}")
        except AnalysisException as missing:  # no rows, no files to tell a schema
            if "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            return {}
        return {str(r[0]): r[1] for r in written.groupBy("_bucket").count().collect()} if "_bucket" in written.columns else {}

    def _publish(self, manifest: dict) -> None:
        from tessera.sources.tables import _point

        _point(self.spark, self.path, json.dumps(manifest))

    def write(self, batch: DataFrame, number: int) -> bool:
        """Add a batch; False if one of this number or a later one was added before."""
        manifest = self._manifest()
        if number <= manifest["last"]:
            return False
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(BUCKETS)).cast("int")
        rows = self._newest(batch.withColumn("_batch", F.lit(number).cast("long")).withColumn("_bucket", bucket))
        folder = f"delta-{number}"
        held = self._store(rows, folder)
        if held:
            manifest["deltas"].append({"folder": folder, "rows": sum(held.values()), "buckets": sorted(held)})
        manifest["last"] = number
        self._publish(manifest)
        if len(manifest["deltas"]) >= MOST_DELTAS:
            self.compact()
        return True

    def compact(self, into_base: bool | None = None) -> None:
        """Merge the deltas: into the base if they hold INTO_BASE of its rows (or as told), else into one."""
        manifest = self._manifest()
        if not manifest["deltas"]:
            return
        deltas = {d["folder"]: None for d in manifest["deltas"]}
        rows, base = sum(d["rows"] for d in manifest["deltas"]), sum(n for _, n in manifest["base"].values())
        if into_base is None:
            into_base = rows >= INTO_BASE * base
        if not into_base:
            folder = f"delta-{uuid.uuid4().hex}"
            held = self._store(self._newest(self._parts(deltas)), folder)
            manifest["deltas"] = [{"folder": folder, "rows": sum(held.values()), "buckets": sorted(held)}]
        else:
            touched = sorted({b for d in manifest["deltas"] for b in d["buckets"]})
            # Deletions stay, so that an older row that comes later doesn't bring its key back.
            merged = self._newest(self._parts(self._base(manifest, touched) | deltas))
            folder = f"base-{uuid.uuid4().hex}"
            held = self._store(merged, folder)
            manifest["base"] = {b: x for b, x in manifest["base"].items() if b not in touched} | {b: [folder, n] for b, n in held.items()}
            manifest["deltas"] = []
        self._publish(manifest)

    def vacuum(self) -> list[str]:
        """Delete folders that the manifest doesn't name; readers of an older one must be done."""
        manifest = self._manifest()
        named = {x for x, _ in manifest["base"].values()} | {d["folder"] for d in manifest["deltas"]}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        gone = [x.getPath() for x in fs.listStatus(root) if x.isDirectory() and x.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
