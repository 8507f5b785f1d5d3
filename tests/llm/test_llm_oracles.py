"""The operators that SQL can express give what DuckDB gives, on the data and on tables with odd rows."""

import duckdb
import pytest

from keyloom.llm import registry

TABLES = ("documents", "embeddings", "pages", "labels")


def compared(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}'")
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(str(row[names.index(c)]) for c in cols) for row in r.fetchall()))
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == want
    return len(want)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, data, name):
    assert compared(spark, data, name)


def test_odd_rows_against_sql(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(45))
    docs = [(1, None), (2, ""), (3, text), (4, f"x {text}"), (5, text), (6, "a " * 60), (7, "a " * 30 + text[:90])]
    pages = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (3, None, None), (4, "v", "x" * 999), (5, "v", "x" * 999)]
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.2], 1), (4, [1.0, 0.3], 1), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, 0.0], 1)]
    root = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    for name in ("op6_lattice", "op8_substring", "op9_warc"):
        compared(spark, root, name)
