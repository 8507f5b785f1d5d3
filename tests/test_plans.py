"""The plans are those that were wanted: filters and columns reach the scan, sums are combined early, pairs are never multiplied out."""

import pytest

from keyloom.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filter_reaches_the_scan(spark, data):
    p = plan(catalogue.QUERIES["orders_for_customer"](spark, data))
    assert "EqualTo(o_custkey,77)" in p and "o_orderpriority" not in p and "Exchange" not in p


@pytest.mark.parametrize("name, columns", [("sort_buckets", "l_extendedprice"), ("low_median", "l_returnflag"), ("parity_pipeline", "l_linenumber")])
def test_only_needed_columns_are_read(spark, data, name, columns):
    p = plan(catalogue.QUERIES[name](spark, data))
    assert columns in p and "l_shipdate" not in p and "l_suppkey" not in p


@pytest.mark.parametrize("name", ["wordcount_documents", "expression_map_reduce", "shard_counts", "kv_last_write_wins", "perf_pivot"])
def test_one_exchange_behind_a_partial_aggregate(spark, data, name):
    p = plan(catalogue.QUERIES[name](spark, data))
    body = p.split("== Physical Plan ==")[1].split("\n\n")[0]
    assert body.count("Exchange (") == 1 and body.count("Aggregate (") == 2 and "Python" not in body


@pytest.mark.parametrize("name", ["owner_of_key", "asof_forward", "bucket_histogram", "bloom_membership", "lookup_correlation", "fountain_encode_xor", "kv_lookup"])
def test_no_product_of_two_tables(spark, data, name):
    p = plan(catalogue.QUERIES[name](spark, data))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_ranks_are_limited_before_the_exchange(spark, data):
    assert plan(catalogue.QUERIES["topk_per_group"](spark, data)).count("WindowGroupLimit") >= 2
