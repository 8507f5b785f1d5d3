"""Order statistics: medians, k-th values, both ends of a queue, running medians.

Ranks inside a group come from counts: ``spread_ranks`` cuts the total order of (group, value) into ranges by
sampling, counts each group's rows in each range, and ranks inside one range only, so a group of any size is
spread over many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.shared import cut


def low_median(x: str) -> Column:
    return F.expr(f"percentile_disc(0.5) within group (order by {x})")


def spread_ranks(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` (from 1) of each row in its group and ``_n``, the group's size."""
    placed = cut(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_here"))
    w = Window.partitionBy(*by).orderBy("_part")  # as many rows of a group as ranges it reaches into
    counts = counts.withColumn("_before", F.sum("_here").over(w) - F.col("_here")).withColumn("_n", F.sum("_here").over(Window.partitionBy(*by)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = placed.alias("a").join(counts.alias("b"), [*same, F.col("a._part") == F.col("b._part")])
    joined = joined.select("a.*", "b._before", "b._n")
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return joined.withColumn("_rank", F.col("_before") + inside).drop("_part", "_before")


def high_median(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """The upper of the two middle values (for an odd number of values the middle one)."""
    return spread_ranks(rows.select(*by, x), by, [x]).where("_rank = floor(_n / 2) + 1").select(*by, F.col(x).alias("high_median"))


def kth_smallest(rows: DataFrame, by: list[str], x: str, k: int, tie: list[str]) -> DataFrame:
    """The k-th value from 0 in order."""
    return spread_ranks(rows.select(*by, x, *tie), by, [x, *tie]).where(F.col("_rank") == k + 1).select(*by, F.col(x).alias("kth"))


def both_ends(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k least and k greatest rows of each group with ``low_rank`` and ``high_rank``.

    Each end is cut by rank on its own, so that each task passes on k rows of a group only.
    """
    up = Window.partitionBy(*by).orderBy(*[F.asc(c) for c in order])
    down = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    low = rows.withColumn("low_rank", F.row_number().over(up)).where(F.col("low_rank") <= k).withColumn("high_rank", F.lit(None).cast("int"))
    high = rows.withColumn("high_rank", F.row_number().over(down)).where(F.col("high_rank") <= k).withColumn("low_rank", F.lit(None).cast("int"))
    both = low.unionByName(high)
    return both.groupBy(*rows.columns).agg(F.max("low_rank").alias("low_rank"), F.max("high_rank").alias("high_rank"))


def without_ends(rows: DataFrame, by: list[str], order: list[str], low: int, high: int) -> DataFrame:
    """What is left of each group's queue after its ``low`` least and ``high`` greatest rows are taken off."""
    ranked = spread_ranks(rows, by, order)
    return ranked.where((F.col("_rank") > low) & (F.col("_rank") <= F.col("_n") - high)).drop("_rank", "_n")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those that are removed; of equal rows as many go as ``gone`` has."""
    w = Window.partitionBy(*keys).orderBy(*keys)
    mine, other = rows.withColumn("_copy", F.row_number().over(w)), gone.select(*keys).withColumn("_copy", F.row_number().over(w))
    return mine.join(other, [*keys, "_copy"], "left_anti").drop("_copy")


def running_median(rows: DataFrame, by: list[str], order: list[str], x: str) -> DataFrame:
    """``median``: the low median of each prefix of a group.

    One stream is a fold over its rows, kept as two heaps, so memory and time grow with the rows, not with their square.
    """
    import heapq

    columns, kinds = [*rows.columns], dict(rows.dtypes)
    key = "_group"

    def run(batches):
        group, low, high = object(), [], []  # low holds negated values, and as many as high or one more
        for b in batches:
            out = []
            for g, v in zip(b.column(len(columns)).to_pylist(), b.column(columns.index(x)).to_pylist()):
                if g != group:
                    group, low, high = g, [], []
                if v is None:  # nothing is added
                    out.append(-low[0] if low else None)
                    continue
                if low and v > -low[0]:
                    heapq.heappush(high, v)
                else:
                    heapq.heappush(low, -v)
                if len(low) > len(high) + 1:
                    heapq.heappush(high, -heapq.heappop(low))
                elif len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
                out.append(-low[0])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(out, b.column(columns.index(x)).type)], names=[*columns, "median"])

    grouped = rows.withColumn(key, F.to_json(F.struct(*by)))
    ordered = grouped.repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", median {kinds[x]}")
