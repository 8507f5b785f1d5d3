"""Sequential folds over arrays: the quality controller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quality(deltas: Column, start: int, cap: int) -> Column:
    """Quality after a series of differences to the wanted rate: steps of 1, of 2 beyond 100, kept in 0 .. cap + 1."""
    def step(q: Column, d: Column) -> Column:
        move = F.signum(d.cast("double")).cast("int") * F.when(F.abs(d) > 100, 2).otherwise(1)
        return F.least(F.greatest(q + move, F.lit(0)), F.lit(cap + 1))

    return F.aggregate(deltas, F.lit(start), step)
