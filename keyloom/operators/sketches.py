"""Membership sketches as tables of (position, count)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import hashing


def sized(n: int, p: float) -> tuple[int, int]:
    """(cells, positions per item) for n items at a false positive rate of p."""
    size = int(-(n * math.log(p)) / 0.480453014)
    return size, int(0.7 * size / n)


def false_positive_rate(n: Column | int, k: int, size: int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.pow(1 - F.exp(-k * n / F.lit(float(size))), F.lit(k))


#: Cells of a filter that is sent along: 256 KB of bits.
PACKED = 1 << 21


class Bloom:
    """A (counting) Bloom filter: ``cells(pos, cnt)``."""

    def __init__(self, cells: DataFrame, k: int, size: int, positions=hashing.positions):
        self.cells, self.k, self.size, self.positions = cells, k, size, positions

    @classmethod
    def of(cls, items: DataFrame, item: Column, k: int, size: int, positions=hashing.positions) -> Bloom:
        at = items.select(F.explode(positions(item, k, size)).alias("pos"))
        return cls(at.groupBy("pos").agg(F.count("*").alias("cnt")), k, size, positions)

    def union(self, other: Bloom) -> Bloom:
        return Bloom(self.cells.unionByName(other.cells).groupBy("pos").agg(F.sum("cnt").alias("cnt")), self.k, self.size, self.positions)

    def intersection(self, other: Bloom) -> Bloom:
        both = self.cells.join(other.cells.select("pos", F.col("cnt").alias("c2")), "pos")
        return Bloom(both.select("pos", F.least("cnt", "c2").alias("cnt")), self.k, self.size, self.positions)

    def removed(self, items: DataFrame, item: Column) -> Bloom:
        """Without the items, which must be in it: a cell that would fall below zero is an error."""
        gone = Bloom.of(items, item, self.k, self.size, self.positions).cells.select("pos", F.col("cnt").alias("c2"))
        left = self.cells.join(gone, "pos", "left").withColumn("cnt", F.col("cnt") - F.coalesce("c2", F.lit(0)))
        left = left.withColumn("cnt", F.when(F.col("cnt") < 0, F.raise_error(F.lit("not in the filter"))).otherwise(F.col("cnt")))
        return Bloom(left.where("cnt > 0").select("pos", "cnt"), self.k, self.size, self.positions)

    def contains(self, items: DataFrame, key: str, item: Column) -> DataFrame:
        """(key, present): whether all positions of an item are taken; false positives only.

        A filter of at most ``PACKED`` cells goes to the items as one value, words of 64 bits, and nothing of theirs is
        shuffled; a larger one is joined.
        """
        if self.size <= PACKED:
            words = -(-self.size // 64)
            # a filter's size is its own, whatever was put into it
            set_bits = self.cells.where("cnt > 0").groupBy(F.expr("cast(pos div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
            row = set_bits.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
            row = row.select(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("_words"))
            asked = items.select(key, self.positions(item, self.k, self.size).alias("_at"), row.scalar().alias("_words"))
            taken = F.forall("_at", lambda p: F.call_function("shiftright", F.element_at("_words", (p / 64).cast("int") + 1), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
            return asked.select(key, taken.alias("present"))
        asked = items.select(key, F.explode(F.array_distinct(self.positions(item, self.k, self.size))).alias("pos"))
        found = asked.join(self.cells.where("cnt > 0").select("pos", F.lit(1).alias("hit")), "pos", "left")
        return found.groupBy(key).agg((F.count("*") == F.count("hit")).alias("present"))

    def removed_if_present(self, items: DataFrame, key: str, item: Column) -> tuple[Bloom, DataFrame]:
        """The filter without those of the items that it holds, and (key, present): whether each was removed."""
        known = self.contains(items, key, item)
        return self.removed(items.join(known.where("present"), key, "left_semi"), item), known

    def capacity(self, p: float) -> int:
        """How many items the filter holds at a false positive rate of ``p``."""
        return int(-self.size / self.k * math.log(1 - p ** (1 / self.k)))

    def overflowed(self, most: int = 255) -> DataFrame:
        """Cells over what a byte counts."""
        return self.cells.where(F.col("cnt") > most)
