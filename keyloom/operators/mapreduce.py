"""Map/reduce jobs as DataFrame plans: emit pairs, group by key, reduce.

With Column expressions for both steps the whole job is one partial aggregate, one exchange and one final
aggregate.  Python functions are for what expressions can't say; their groups are read as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import text
from keyloom.operators.shared import cut


@dataclass(frozen=True)
class Job:
    """``emit``: an array of struct(key, value) per input row; ``reduce``: an aggregate over ``value``."""

    emit: Column
    reduce: Column

    def run(self, rows: DataFrame, store: Callable[[DataFrame], object] | None = None) -> DataFrame:
        """(key, result); with ``store`` the results also go to that sink, where the executors write them."""
        out = self.pairs(rows)
        if store is not None:
            store(out)
        return out

    def pairs(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(self.emit).alias("kv")).select("kv.key", "kv.value").groupBy("key").agg(self.reduce.alias("result"))


def python_job(rows: DataFrame, columns: list[str], map_fn: Callable[..., Iterable[tuple]], reduce_fn: Callable[[str, list], object],
               key: str = "string", value: str = "long", result: str = "long", combine: bool = False) -> DataFrame:
    """A job of two Python functions: ``map_fn(*columns)`` gives pairs, ``reduce_fn(key, values)`` one result.

    With ``combine`` the reduction is also applied inside each map batch, for functions that allow it.
    """
    def emit(batches):
        for b in batches:
            pairs = [p for row in zip(*(c.to_pylist() for c in b.columns)) for p in map_fn(*row)]
            if combine:
                bags: dict = {}
                for k, v in pairs:
                    bags.setdefault(k, []).append(v)
                pairs = [(k, reduce_fn(k, vs)) for k, vs in bags.items()]
            yield pa.RecordBatch.from_pylist([{"key": k, "value": v} for k, v in pairs], schema=pa.schema([("key", kinds[key]), ("value", kinds[value])]))

    def fold(table: pa.Table) -> pa.Table:
        k = table.column("key")[0].as_py()
        return pa.table({"key": pa.array([k], kinds[key]), "result": pa.array([reduce_fn(k, table.column("value").to_pylist())], kinds[result])})

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    pairs = rows.select(*columns).mapInArrow(emit, f"key {key}, value {value}")
    return pairs.groupBy("key").applyInArrow(fold, f"key {key}, result {result}")


def word_count(docs: DataFrame, column: str = "text", by: list[str] | None = None) -> DataFrame:
    """(by.., word, n)."""
    by = by or []
    return docs.select(*by, F.explode(text.words(F.col(column))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def chunks(docs: DataFrame, size: int, column: str = "text") -> DataFrame:
    """(doc_id, chunk, words): the words of a text in chunks of ``size``, split at single spaces."""
    pieces = docs.select("doc_id", F.posexplode(F.split(column, " ")).alias("pos", "piece"))
    return pieces.groupBy("doc_id", F.floor(F.col("pos") / size).cast("int").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("words"))


def range_bucket(x: Column, width: int) -> Column:
    """The bucket of a number in ranges of ``width``, truncated toward zero."""
    return (F.expr("1L") * F.when(x >= 0, F.floor(x / width)).otherwise(F.ceil(x / width)).cast("long") * width).cast("long")


def total_sort(rows: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """All rows in order: a range exchange by sampling and a sort in each range, with no fixed width to skew it."""
    out = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return out.sortWithinPartitions(*order)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` (from 1) of each row in the total order of the columns.

    Ranges come from a sample of the rows, so they hold about equally many whatever the values; counts of the ranges
    give what stands before each, and no task sorts all rows.  The range of a row is written down, as a task that
    runs again must not draw another.
    """
    marked = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return marked.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + own).drop("_part", "_before")
