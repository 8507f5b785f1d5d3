"""Registration of queries: each a function of (spark, sf_dir), with the SQL of its oracle if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, oracle: str | None = None):
    """Register a function of the named tables; it gets them as DataFrames."""
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[files.table(spark, sf_dir, t) for t in tables])

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def query_at(oracle: str | None = None):
    """Register a function of (spark, sf_dir) as it is."""
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def micros(column: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"unix_micros(cast({column} as timestamp))")
