"""Window-like operators over ordered events: islands, rates, layouts, admission, throttling."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators import mapreduce


def ring_layout(nodes: DataFrame, digest: Column) -> DataFrame:
    """Places on a circle in the order of a digest: ``idx``, ``x``, ``y``."""
    ranks = mapreduce.ranked(nodes.withColumn("_digest", digest), ["_digest"]).withColumn("idx", (F.col("rank") - 1).cast("long"))
    n = nodes.count()
    angle = F.col("idx") / F.lit(max(n, 1)) * (2 * math.pi)
    return ranks.select(*[F.col(f"`{c}`") for c in nodes.columns], "idx", (F.round(F.cos(angle), 6) + 0.0).alias("x"), (F.round(F.sin(angle), 6) + 0.0).alias("y"))


def failure_runs(rows: DataFrame, by: list[str], order: list[str], failed: Column, threshold: int) -> DataFrame:
    """``run``: failures in a row so far (0 at a success); ``tripped``: the threshold is passed."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(upto)
    out = rows.withColumn("_island", island).withColumn("_fail", failed.cast("int"))
    run = F.sum("_fail").over(Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("run", run).withColumn("tripped", F.col("run") >= threshold).drop("_island", "_fail")


def misses_so_far(rows: DataFrame, by: list[str], order: list[str], missing: Column, most: int) -> DataFrame:
    """Rows before the number of misses, which is never reset, goes over ``most``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("misses", F.sum(missing.cast("int")).over(w)).where(F.col("misses") <= most)


def rates(rows: DataFrame, by: list[str], order: list[str], micros: Column, amount: Column, every: int = 11) -> DataFrame:
    """Per group of ``every`` rows: the amount over the seconds since the last row of the group before."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_g", F.floor((F.row_number().over(w) - 1) / every).cast("long")).withColumn("_t", micros).withColumn("_a", amount)
    sums = rows.groupBy(*by, "_g").agg(F.sum("_a").alias("amount"), F.max("_t").alias("_end"), F.count("*").alias("n"))
    before = F.lag("_end").over(Window.partitionBy(*by).orderBy("_g"))
    seconds = (F.col("_end") - before) / 1e6
    return sums.where(F.lit(True)).withColumn("rate", F.when(seconds > 0, F.col("amount") / seconds)).select(*by, F.col("_g").alias("grp"), "n", "amount", "rate")


def admitted(rows: DataFrame, by: list[str], child: str, order: list[str], most: int = 2) -> DataFrame:
    """Whether a request is accepted: the child is among the first ``most`` of its parent to ask."""
    first = rows.groupBy(*by, child).agg(F.min(F.struct(*order)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_first", child))
    return rows.join(first.withColumn("_place", place).drop("_first"), [*by, child]).withColumn("accepted", F.col("_place") <= most).drop("_place")


def throttled(rows: DataFrame, by: list[str], micros: Column, gap: int) -> DataFrame:
    """(by.., t): times accepted when each must come more than ``gap`` microseconds after the last accepted.

    One pass over the times in order, which keeps one number for a stream; the rule is sequential, so a stream is one task.
    """
    kinds = dict(rows.dtypes)
    keyed = rows.select(*by, F.to_json(F.struct(*by)).alias("_key"), micros.cast("long").alias("t")).repartition("_key").sortWithinPartitions("_key", "t")

    def run(batches):
        key, last = object(), 0
        for b in batches:
            kept = []
            for i, (k, t) in enumerate(zip(b.column(len(by)).to_pylist(), b.column(len(by) + 1).to_pylist())):
                if k != key or t - last > gap:
                    key, last = k, t
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64())).drop_columns(["_key"])

    return keyed.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", t long")


def after_last(rows: DataFrame, by: list[str], order: list[str], control_row: Column) -> DataFrame:
    """Rows after the last control row of their group (all, if there is none)."""
    mark = F.max(F.when(control_row, F.struct(*order))).over(Window.partitionBy(*by))
    return rows.withColumn("_mark", mark).where(F.col("_mark").isNull() | (F.struct(*order) > F.col("_mark"))).drop("_mark")
