"""Running totals over as many keys as there are, without a one-task window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys in a span; spans are summed apart and only their totals meet in one task.
SPAN = 4096


def running_total(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``n`` over all smaller integer keys."""
    spans = counts.withColumn("_span", F.floor(F.col(key) / SPAN))
    heads = spans.groupBy("_span").agg(F.sum(n).alias("_sum"))
    heads = heads.select("_span", (F.sum("_sum").over(Window.orderBy("_span")) - F.col("_sum")).alias("_lead"))
    inside = F.sum(n).over(Window.partitionBy("_span").orderBy(key)) - F.col(n)
    return spans.withColumn("_inside", inside).join(heads, "_span").withColumn(name, F.col("_lead") + F.col("_inside")).drop("_span", "_inside", "_lead")
