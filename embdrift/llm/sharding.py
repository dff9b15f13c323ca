"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

The rows get one fixed order: (bucket, id, text checksum), bucket a hash of id and text. Per-bucket
totals are summed first, their running sums give each bucket's global start, and a window inside
each bucket gives every row's own start. A row belongs to the shard in whose equal share of all
bytes it starts, so shards are contiguous in that order and differ from the target by less than
one row. No task sees more than one bucket, no id pattern or arrival order can make a bucket large
(only copies of one row under one id share a hash), and the table of totals has ``buckets`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(buckets: int, *cols: Column) -> Column:
    """0 to buckets-1 from the md5 of the columns (null: empty): the same in every SQL engine."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def shard_by_bytes(docs: DataFrame, shards: int, buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text plus 1 (null text: 1, its checksum that of the empty text).
    shard: 0 to ``shards`` - 1; slot: place in the shard, gapless from 0. Null ids and repeated
    rows are rows like others; equal rows may change places. An empty table gives no rows.
    ``buckets``: parts of the order; raise it with the input (about a million rows each).
    """
    if shards < 1 or buckets < 1:
        raise ValueError("shards and buckets must be positive")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("bucket", hash_bucket(buckets, F.col("doc_id"), F.col("text_crc32")))
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # ``totals`` has at most ``buckets`` rows: one task sums them, whatever the input.
    starts = totals.select(
        "bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"),
        F.sum("bytes").over(everything).alias("all_bytes"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    placed = rows.join(F.broadcast(starts), "bucket").select(
        "doc_id", "size", "text_crc32",
        (F.col("bytes0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .alias("start"),
        (F.col("rank0") + F.row_number().over(inside) - 1).alias("rank"), "all_bytes")
    placed = placed.withColumn(
        "shard", F.expr(f"cast(cast(start as decimal(38,0)) * {int(shards)} div all_bytes as int)")).drop("all_bytes")
    # A shard is contiguous in rank: its first rank makes slots of ranks (``shards`` rows).
    first = placed.groupBy("shard").agg(F.min("rank").alias("rank0"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("rank0")).cast("bigint").alias("slot"))
