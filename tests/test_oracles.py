"""Every query with an oracle gives what DuckDB gives on the same tables; the others run."""

import math

import duckdb
import numpy as np
import pytest

from keyloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, data, con):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    if name not in catalogue.ORACLES:
        assert mine
        return
    r = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(tuple(shown(x[i]) for i in at) for x in r.fetchall())


def test_oracles_have_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
