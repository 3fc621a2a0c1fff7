"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters rows by a seeded hash into buckets that fit a task's memory;
ranges of buckets share a bounded number of partitions. Pass two permutes each
bucket: Spark's seeded ``shuffle`` (an inside-out Fisher-Yates) permutes the
bucket's places, and its rows, in hash order, take them. Only places are held in
an array, rows are sorted with spilling. Buckets laid end to end are the global
order; shard and slot are the remainder and quotient of a row's place in it, so
shard counts differ by one at most (law ``rows``).

Equal rows are counted, sent once, and numbered, and the number is part of the
hash: copies spread over all buckets, and a row that a third of the table
repeats is never gathered by one task. A repeated row is made again in chunks.

Defined results: a null text counts 8 bytes and has the checksum of the empty
text; null ids and ids of any type are taken as they are; repeated rows each get
a place; very long texts are moved like others; an empty table gives an empty
table; columns of any type pass through, maps too, and an input column named
like one of the operator's is replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tessera.llm.spans import running_total
from tessera.sources.scratch import Scratch

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Bytes of rows in a bucket, what a row counts besides its text, and most partitions that share the buckets.
BUCKET_BYTES, ROW_BYTES, MOST_PARTS = 16 << 20, 128, 32_768
#: Copies of a row made by one task.
CHUNK = 4096
#: Bytes of rows in a file of a written shard.
FILE_BYTES = 512 << 20


def has_order(kind: DataType) -> bool:
    """Whether columns of this type can be grouped and sorted by."""
    if isinstance(kind, StructType):
        return all(has_order(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return has_order(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def _copies(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _made_again(rows: DataFrame, parts: int) -> DataFrame:
    """Each row ``n`` times, numbered in ``copy``; chunks of a much repeated row go to different tasks."""
    few = rows.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(_copies("n")))
    many = rows.where(F.col("n") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    many = many.repartition(parts, "k1", "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1
    return few.unionByName(many.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk"))


def external_shuffle(docs: DataFrame, shards: int = 24, seed: int = 11, keep: list[str] | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default) in a seeded random order, dealt to ``shards`` shards.

    Adds size (UTF-8 bytes of ``text`` plus 8), text_crc32, law, shard, slot and
    grown_shard (null: the law is not by key). The order depends on the seed and
    on the rows alone, however they are partitioned.
    """
    scratch = Scratch(docs.sparkSession, "shuffle")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    cell = [f"c{i}" for i in range(len(keep))]
    plain = [has_order(docs.schema[c].dataType) for c in keep]
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(raw).cast("long") + 8
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, cell, strict=True)], F.col("doc_id").cast("string").alias("id"), size.alias("size"), F.crc32(raw.cast("binary")).alias("crc"))
    # What makes a row itself: its id, text, and columns; those without an order count as JSON.
    same = {x: F.col(x) if ok else F.to_json(F.struct(x)) for c, x, ok in zip(keep, cell, plain, strict=True) if c not in ("doc_id", "text")}
    of = ["id", "crc", "size", *same.values()]
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(seed), *of), "k2": F.xxhash64(F.lit(seed + 1), *of)})
    weight = (F.col("size") if "text" in keep else F.lit(8)) + ROW_BYTES
    keys = scratch.table(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")), "keys")
    total, most = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    parts = min(buckets, MOST_PARTS)

    if most > 1:
        first = [F.first(x).alias(x) for x, ok in zip(cell, plain, strict=True) if not ok]
        rows = rows.groupBy("k1", "k2", "id", "size", "crc", *[x for x, ok in zip(cell, plain, strict=True) if ok]).agg(F.count("*").alias("n"), *first)
        rows, keys = _made_again(rows, parts), _made_again(keys.select("k1", "k2", "n"), parts)
    else:
        rows, keys = (x.withColumn("copy", F.lit(0).cast("long")) for x in (rows, keys))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "copy"), F.lit(buckets)).cast("int").alias("bucket")
    counts = running_total(keys.groupBy(bucket).agg(F.count("*").alias("n")), "bucket", "n", "before")
    # The same partitions in the same order at every run, so what shuffle() draws depends on the seed alone.
    places = counts.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "before", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(seed)).alias("places"))

    rows = rows.select("*", bucket, F.xxhash64(F.lit(seed + 2), "k1", "k2", "copy").alias("mark")).repartition(parts, "bucket")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("mark", "k1", "k2", "copy"))
    # Both sides are dealt and sorted by bucket already; places grow with the rows, so they are never broadcast.
    met = rows.withColumn("rank", rank).join(places.hint("merge"), "bucket")
    place = F.col("before") + F.element_at("places", F.col("rank"))
    return met.withColumn("place", place).select(
        *[F.col(x).alias(c) for c, x in zip(keep, cell, strict=True)],
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shuffled_rows(docs: DataFrame, **named: int) -> DataFrame:
    """``external_shuffle`` of all columns; those of ``docs`` that bear a name it adds come as ``own_<name>``."""
    of = {c: f"own_{c}" for c in docs.columns if c.lower() in ADDED}
    return external_shuffle(docs.select(*[F.col(f"`{c}`").alias(of.get(c, c)) for c in docs.columns]), **named)


def write_shards(shuffled: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """One folder a shard, in files of some ``file_bytes`` that hold ranges of slots in order."""
    shards, total = shuffled.agg(F.countDistinct("shard"), F.coalesce(F.sum("size"), F.lit(0))).first()
    files = max(1, shards, math.ceil(total / file_bytes))
    shuffled.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
