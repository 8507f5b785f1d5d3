"""Contiguous shards of nearly equal bytes, by global prefix sums, in DataFrame operations only.

Rows are dealt to ranges of doc_id; each range's total and row count (one row per range) are summed
up in order, and each range adds its own running sums to what stands before it.  That gives every
row its global offset in bytes and its global index without any task seeing more than one range.
A row goes to the shard in whose equal stretch of bytes its middle lies.

Defined cases: a null text has no bytes (size 1, CRC of the empty text); a null doc_id comes first;
rows with equal doc_id are ordered by size and CRC, and rows equal in all three are alike, so any
order of them gives the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, empty_text


def byte_shards(docs: DataFrame, shards: int = 16, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs(doc_id, text)``.

    ``slot`` counts the rows of a shard from 0 in the order of doc_id.  The law is ``bytes``;
    ``grown_shard`` belongs to another law and is null.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "shards")
    text = empty_text()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    # the range of a row is written down: it must not change if a task is run again
    rows = ws.save(rows.repartitionByRange("doc_id", "size", "crc").withColumn("part", F.spark_partition_id()), "sized")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # one row for each range: as many as there are partitions, which no data makes more
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ws.save(totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("total")), "ranges")
    own = Window.partitionBy("part").orderBy("doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(totals, "part").select(
        "doc_id", "size", "crc",
        (F.col("bytes_before") + F.sum("size").over(own) - F.col("size")).alias("offset"),
        (F.col("rows_before") + F.row_number().over(own) - 1).alias("index"), "total")
    middle = F.expr(f"least((2 * offset + size) * {shards} div (2 * total), {shards - 1})")
    placed = ws.save(placed.withColumn("shard", middle.cast("int")), "placed")
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
