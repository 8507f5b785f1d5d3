"""Delimited sources and sinks: contact lists, metric rows, logs by date, nested and compressed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "tables int, dead int, min int, avg double, max int, total_lookups long"
NETWORK_STEPS = "nodes int, " + ", ".join(f"s{i} int" for i in range(1, 11)) + ", mean double"
SERIES = "idx int, value int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_contacts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ip, port, id) of lines 'ip port id'; lines that don't parse are left out."""
    p = F.split(F.trim(column), " ")
    out = lines.select(F.get(p, F.lit(0)).alias("ip"), F.get(p, F.lit(1)).try_cast("int").alias("port"), F.get(p, F.lit(2)).alias("id"), F.size(p).alias("n"))
    octets = F.split("ip", r"\.")
    good = (F.size(octets) == 4) & F.forall(octets, lambda o: F.coalesce(o.try_cast("int").between(0, 255), F.lit(False)))
    return out.where((F.col("n") == 3) & good & F.col("port").between(0, 65535) & (F.length("id") > 0)).drop("n")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    return parsed_contacts(spark.read.text(path))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headerless table of numbers."""
    return spark.read.schema(schema).csv(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path)


def write_log(rows: DataFrame, path: str, day: Column) -> None:
    """Messages in a folder for each day."""
    rows.withColumn("day", day).write.mode("overwrite").partitionBy("day").json(path)


def write_compressed(rows: DataFrame, path: str, codec: str = "gzip") -> None:
    rows.write.mode("overwrite").option("compression", codec).parquet(path)


def nested_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders, each with its lines as an array of structs in the order of line number."""
    kept = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"))).alias("lines"))
    return orders.join(kept, orders.o_orderkey == kept.l_orderkey, "left").drop("l_orderkey")


def unmuted(messages: DataFrame, muted: DataFrame, pipe: str) -> DataFrame:
    """Messages of pipes that are not muted."""
    return messages.join(muted.select(pipe).distinct(), pipe, "left_anti")
