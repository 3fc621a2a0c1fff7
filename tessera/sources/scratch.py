"""Intermediate tables in the folder that all executors share.

A lost executor must never lose an intermediate result, so lineage is cut by a
written table under ``spark.checkpoint.dir``; nothing is kept on one machine.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one where it is unset and Spark is local."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


class Scratch:
    """A fresh folder for one query's intermediate tables."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written rows."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        """Delete the whole folder; runs when the driver ends, as results may be read until then."""
        with contextlib.suppress(Exception):
            self.drop(".")

    def drop(self, *names: str) -> None:
        """Delete tables no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
