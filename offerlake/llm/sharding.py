"""Contiguous shards of near equal bytes, by prefix sums over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: What a row takes besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """One row (doc_id, size, text_crc32, shard, slot) for each row of docs (doc_id, text).

    Rows are put in order of doc_id; shard k takes those whose first byte lies in the k-th of `shards` equal parts of
    all bytes, so a shard misses its target by less than one row at either end. slot counts from 0 within a shard.
    Only ids, sizes and checksums are shuffled: a range of ids goes to each partition, the partitions' totals (one
    row each) give every partition its offsets, and rows add their sums within the partition. Null texts count as
    empty. Rows of equal ids, null ids among them (which come first), are ordered by checksum and size; what is then
    left of ties are equal rows. Other columns are ignored; an empty table gives an empty one. With fewer rows than
    shards some shards stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = ["doc_id", "text_crc32", "size"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = totals.select(  # as many rows as there are partitions
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("bytes_in_all"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        dealt.withColumn("from_byte", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("from_row", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "part")
        .withColumn("shard", F.expr(f"cast((bytes_before + from_byte) * {shards} div bytes_in_all as int)"))
        .withColumn("at", F.col("rows_before") + F.col("from_row"))
        .select(*order, "shard", "at")
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # as many rows as there are shards
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
