"""Keyed stores as op logs: the last write of a key wins, a null value deletes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Store(Protocol):
    def put(self, rows: DataFrame) -> "Store": ...

    def get(self, keys: DataFrame) -> DataFrame: ...


def current(log: DataFrame, key: str, value: str, seq: list[str]) -> DataFrame:
    """(key, value) as of the end of the log, without deleted keys: one partial aggregate, no sort."""
    last = log.groupBy(key).agg(F.max(F.struct(*seq, F.col(value).alias("_value"))).alias("_last"))
    return last.select(key, F.col("_last._value").alias(value)).where(F.col(value).isNotNull())


class KeyValueStore:
    """An immutable view of a log of (key, value, seq); ``put`` and ``delete`` add to it."""

    def __init__(self, log: DataFrame):
        self.log = log

    def put(self, rows: DataFrame) -> KeyValueStore:
        return KeyValueStore(self.log.unionByName(rows.select("key", "value", "seq")))

    def delete(self, keys: DataFrame) -> KeyValueStore:
        kind = self.log.schema["value"].dataType
        return self.put(keys.select("key", F.lit(None).cast(kind).alias("value"), "seq"))

    def view(self) -> DataFrame:
        return current(self.log, "key", "value", ["seq"])

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value), null where there is none."""
        return keys.select("key").join(self.view(), "key", "left")


def latest(rows: DataFrame, keys: list[str], value: Column, seq: list[str]) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*seq, value.alias("_v")))["_v"].alias("value"))


def lru(rows: DataFrame, item: str, seq: list[str]) -> DataFrame:
    """(item, last_seq.., uses): least recently used first, if ordered by the sequence columns."""
    return rows.groupBy(item).agg(F.max(F.struct(*seq)).alias("_l"), F.count("*").alias("uses")).select(item, "_l.*", "uses")


def lru_left(rows: DataFrame, item: str, seq: list[str], removes: Column) -> DataFrame:
    """(item, last_seq..): as ``lru``, when some rows take their item out of the queue instead of using it."""
    last = rows.groupBy(item).agg(F.max(F.struct(*seq, removes.alias("_gone"))).alias("_l"))
    return last.where("not _l._gone").select(item, *[F.col(f"_l.{c}") for c in seq])


def merged(rows: DataFrame, key: str, seq: list[str], scalars: list[str], repeated: list[str]) -> DataFrame:
    """Records of one key merged in order: scalars keep the last value that isn't null, lists are appended."""
    def last(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(*seq, F.col(c).alias("_v"))))["_v"].alias(c)

    def joined(c: str) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*seq, F.col(c).alias("_v")))), lambda x: x["_v"])).alias(c)

    return rows.groupBy(key).agg(*map(last, scalars), *map(joined, repeated))
