"""Queries of counting, sorting, aggregation, order statistics and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import text
from keyloom.operators import mapreduce, orderstats, store
from keyloom.operators.shared import folder
from keyloom.plans.base import query, query_at
from keyloom.sources import files

_WORDS = """select {cols} unnest(list_filter(string_split(translate(lower(text), '.,"-', '    '), ' '), lambda w: w <> '')) as word from documents"""


@query("documents", oracle=f"select word, count(*) as n from ({_WORDS.format(cols='')}) group by word")
def wordcount_documents(docs: DataFrame) -> DataFrame:
    return mapreduce.word_count(docs)


@query("documents", oracle=f"select word, count(*) as n from ({_WORDS.format(cols='')}) group by word order by n desc, word limit 100")
def wordcount_top(docs: DataFrame) -> DataFrame:
    """A top-k report."""
    return mapreduce.word_count(docs).orderBy(F.desc("n"), "word").limit(100)


@query("documents", oracle=f"select lang, word, count(*) as n from ({_WORDS.format(cols='lang,')}) group by lang, word")
def wordcount_by_lang(docs: DataFrame) -> DataFrame:
    return mapreduce.word_count(docs, by=["lang"])


@query("documents", oracle=f"select word, count(*) as n from ({_WORDS.format(cols='')}) group by word")
def wordcount_chunk_invariance(docs: DataFrame) -> DataFrame:
    """Counted over chunks of four pieces; the result doesn't depend on the chunks."""
    return mapreduce.word_count(mapreduce.chunks(docs, 4), "words")


@query("documents", oracle=f"select word as key, count(*) as result from ({_WORDS.format(cols='')}) group by word")
def expression_map_reduce(docs: DataFrame) -> DataFrame:
    pairs = F.transform(text.words(F.col("text")), lambda w: F.struct(w.alias("key"), F.lit(1).alias("value")))
    return mapreduce.Job(pairs, F.count("value")).run(docs)


@query("documents", oracle="select lang as key, sum(length(text))::bigint as result from documents group by lang")
def udf_map_reduce(docs: DataFrame) -> DataFrame:
    """The general job of two Python functions, combined in each map batch."""
    return mapreduce.python_job(docs, ["lang", "text"], lambda lang, t: [(lang, len(t))], lambda _, vs: sum(vs), combine=True)


@query("lineitem", oracle="select bucket, count(*) as n, min(v) as low, max(v) as high from (select v, (trunc(v / 50000.0) * 50000)::bigint as bucket from (select floor(l_extendedprice * 100)::bigint as v from lineitem)) group by bucket")
def sort_buckets(lines: DataFrame) -> DataFrame:
    v = lines.select(F.floor(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    return v.withColumn("bucket", mapreduce.range_bucket(F.col("v"), 50_000)).groupBy("bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("orders", oracle="select o_orderkey, o_custkey, row_number() over (order by o_custkey, o_orderkey) as rank from orders")
def sort_total_rank(orders: DataFrame) -> DataFrame:
    return mapreduce.ranked(orders.select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("orders", oracle="select o_orderkey, o_totalprice from orders")
def sort_ranges(orders: DataFrame) -> DataFrame:
    """The total sort as ranges sorted each for itself."""
    return mapreduce.total_sort(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("orders", oracle="select ((o_orderkey - lo) // 1000)::bigint as slice, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from orders, (select min(o_orderkey) as lo from orders) group by 1")
def chunk_slices(orders: DataFrame) -> DataFrame:
    """Shards of index ranges."""
    low = orders.agg(F.min("o_orderkey")).first()[0] or 0
    return orders.groupBy(F.floor((F.col("o_orderkey") - low) / 1000).alias("slice")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("customer", oracle="select (c_custkey % 16)::bigint as shard, count(*) as n, round(sum(c_acctbal), 2) as balance from customer group by 1")
def shard_counts(customers: DataFrame) -> DataFrame:
    return customers.groupBy(F.pmod("c_custkey", F.lit(16)).cast("long").alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("events", oracle="select day, lo, mean, hi, n, sum(n) over (order by day)::bigint as total from (select cast(ts as date) as day, min(value) as lo, round(avg(value), 6) as mean, max(value) as hi, count(*) as n from events group by 1)")
def metrics_min_avg_max(events: DataFrame) -> DataFrame:
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.min("value").alias("lo"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("hi"), F.count("*").alias("n"))
    return daily.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # one row a day


@query("orders", "lineitem", oracle="""select o_custkey, count(distinct o_orderkey) as n_orders, count(l_orderkey) as n_lines, coalesce(sum(l_quantity), 0)::double as units,
    round(coalesce(sum(l_quantity * l_extendedprice), 0), 2) as amount, round(coalesce(sum(nullif(l_tax, 0)), 0), 6) as tax
    from orders left join lineitem on o_orderkey = l_orderkey group by o_custkey""")
def nested_order_rollup(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines summed up per order before the join, then orders per customer."""
    per = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("a"), F.sum(F.nullif("l_tax", F.lit(0.0))).alias("t"))
    rows = orders.select("o_orderkey", "o_custkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), zero("n").alias("n_lines"), zero("q").cast("double").alias("units"), F.round(zero("a"), 2).alias("amount"), F.round(zero("t"), 6).alias("tax"))


@query("orders", "lineitem", oracle="select o_orderkey, count(l_orderkey) as n_lines, coalesce(sum(l_quantity), 0)::double as units from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def nested_children(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Over orders with their lines nested inside."""
    nested = files.nested_orders(orders.select("o_orderkey"), lines)
    return nested.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["l_quantity"]), F.lit(0.0)).alias("units"))


@query_at(oracle="select o_orderkey, o_custkey, o_totalprice from orders where o_custkey = 77")
def orders_for_customer(spark, sf_dir: str) -> DataFrame:
    """Parameterised SQL; the filter reaches the scan."""
    return spark.sql("select o_orderkey, o_custkey, o_totalprice from {orders} where o_custkey = :id", args={"id": 77}, orders=files.table(spark, sf_dir, "orders"))


@query("lineitem", oracle="""select count(*) as n, count(*) filter (l_linenumber % 2 = 0) as even, count(*) filter (l_linenumber % 2 = 1) as odd,
    round(avg(l_quantity) filter (l_linenumber % 2 = 0), 6) as even_mean, bool_and(l_quantity > 0) as all_positive from lineitem""")
def parity_pipeline(lines: DataFrame) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    return lines.agg(F.count("*").alias("n"), F.count_if(even).alias("even"), F.count_if(F.col("l_linenumber") % 2 == 1).alias("odd"),
                     F.round(F.avg(F.when(even, F.col("l_quantity"))), 6).alias("even_mean"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"))


@query("lineitem", oracle="select l_orderkey, l_linenumber, l_quantity from lineitem where l_linenumber % 2 = 0")
def parity_filter(lines: DataFrame) -> DataFrame:
    return lines.where("l_linenumber % 2 = 0").select("l_orderkey", "l_linenumber", "l_quantity")


_TYPES = ["signup", "view", "error", "click", "purchase"]


@query("events", oracle="select user_id, " + ", ".join(f"arg_max(value, event_id) filter (event_type = '{t}') as {t}" for t in _TYPES) + ", bool_and(value >= 0) as fine from events group by user_id")
def perf_pivot(events: DataFrame) -> DataFrame:
    """Long to wide: the last value of each type, as conditional aggregates of one pass."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(*[F.max_by(F.when(kind == t, F.col("value")), F.when(kind == t, F.col("event_id"))).alias(t) for t in _TYPES], F.bool_and(F.col("value") >= 0).alias("fine"))


@query("customer", "supplier", oracle="select c_nationkey as nation from customer union select s_nationkey from supplier")
def distinct_union(customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_nationkey").alias("nation")).union(suppliers.select("s_nationkey")).distinct()


@query("customer", "supplier", oracle="select nation, count(*) as n from (select c_nationkey as nation from customer union all select s_nationkey from supplier) group by nation")
def bag_concat(customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_nationkey").alias("nation")).unionAll(suppliers.select("s_nationkey")).groupBy("nation").agg(F.count("*").alias("n"))


@query("lineitem", oracle="""with f as (select l_orderkey, bool_or(l_returnflag = 'R') as r, bool_or(l_linestatus = 'O') as o from lineitem group by 1) select l_orderkey from f where r <> o""")
def symmetric_difference(lines: DataFrame) -> DataFrame:
    """Orders with lines that were returned or are open, but not both: one aggregate in place of two set operations."""
    f = lines.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_linestatus") == "O").alias("o"))
    return f.where("r <> o").select("l_orderkey")


@query("lineitem", oracle="""select l_orderkey, list_sort(list_distinct(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))))::varchar as xor_set,
    (len(list_filter(a, lambda x: not list_contains(b, x))) = 0 and len(a) < len(b)) as proper_subset from
    (select l_orderkey, coalesce(list(distinct l_suppkey) filter (l_linenumber % 2 = 0), []) as a, coalesce(list(distinct l_suppkey) filter (l_quantity > 25), []) as b from lineitem group by l_orderkey)""")
def block_sets(lines: DataFrame) -> DataFrame:
    """Set algebra on arrays: symmetric difference and proper subset."""
    s = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("b"))
    xor_set = F.array_sort(F.array_union(F.array_except("a", "b"), F.array_except("b", "a")))
    shown = F.concat(F.lit("["), F.array_join(xor_set.cast("array<string>"), ", "), F.lit("]"))
    return s.select("l_orderkey", shown.alias("xor_set"), ((F.size(F.array_except("a", "b")) == 0) & (F.size("a") < F.size("b"))).alias("proper_subset"))


@query("customer", "orders", oracle="select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 400000)")
def anti_join_seen(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return customers.join(orders.where("o_totalprice > 400000"), customers.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@query("lineitem", oracle="select l_returnflag, quantile_disc(l_extendedprice, 0.5) as low_median from lineitem group by l_returnflag")
def low_median(lines: DataFrame) -> DataFrame:
    return lines.groupBy("l_returnflag").agg(orderstats.low_median("l_extendedprice").alias("low_median"))


@query("lineitem", oracle="""select l_suppkey, l_quantity as high_median from (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by l_quantity) as r, count(*) over (partition by l_suppkey) as n from lineitem) where r = n // 2 + 1""")
def high_median(lines: DataFrame) -> DataFrame:
    return orderstats.high_median(lines, ["l_suppkey"], "l_quantity")


@query("part", oracle="select p_brand, p_retailprice as kth from (select p_brand, p_retailprice, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as r from part) where r = 10")
def kth_smallest(parts: DataFrame) -> DataFrame:
    return orderstats.kth_smallest(parts, ["p_brand"], "p_retailprice", 9, ["p_partkey"])


@query("part", oracle="select p_brand, count(*) filter (p_retailprice < mid) as below, count(*) filter (p_retailprice >= mid) as above from part join (select p_brand as b, quantile_disc(p_retailprice, 0.5) as mid from part group by 1) on b = p_brand group by p_brand")
def pivot_partition(parts: DataFrame) -> DataFrame:
    """Two sides of each brand's pivot."""
    pivot = parts.groupBy(F.col("p_brand").alias("b")).agg(orderstats.low_median("p_retailprice").alias("pivot"))
    return parts.join(pivot, F.col("p_brand") == F.col("b")).groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") < F.col("pivot")).alias("below"), F.count_if(F.col("p_retailprice") >= F.col("pivot")).alias("above"))


_RANK = "row_number() over (partition by o_custkey order by o_totalprice {0}, o_orderkey {0})"


@query("orders", oracle=f"select o_custkey, o_orderkey, o_totalprice, r as rank from (select *, {_RANK.format('desc')} as r from orders) where r <= 3")
def topk_per_group(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey"))
    return orders.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long"))


@query("orders", oracle=f"select o_custkey, o_orderkey, o_totalprice, r as rank from (select *, {_RANK.format('asc')} as r from orders) where r <= 3")
def bottomk_per_group(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return orders.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long"))


@query("orders", oracle=f"select o_custkey, o_totalprice, o_orderkey, case when lo <= 2 then lo end as low_rank, case when hi <= 2 then hi end as high_rank from (select *, {_RANK.format('asc')} as lo, {_RANK.format('desc')} as hi from orders) where lo <= 2 or hi <= 2")
def both_ends(orders: DataFrame) -> DataFrame:
    """Both ends of a double-ended queue per customer."""
    ends = orderstats.both_ends(orders.select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 2)
    return ends.withColumns({c: F.col(c).cast("long") for c in ("low_rank", "high_rank")})


@query("orders", oracle="""with o as (select o_custkey, o_orderkey, o_totalprice, list(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as seen from orders)
    select o_custkey, o_orderkey, list_sort(seen)[(len(seen) + 1) // 2] as median from o""")
def running_median(orders: DataFrame) -> DataFrame:
    return orderstats.running_median(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "median")


@query("events", oracle="select user_id, max(ts) as last_ts, arg_max(event_id, (ts, event_id)) as event_id, count(*) as uses from events group by user_id")
def lru_order(events: DataFrame) -> DataFrame:
    """Users from least to most recently active."""
    return store.lru(events, "user_id", ["ts", "event_id"]).withColumnRenamed("ts", "last_ts").orderBy("last_ts", "event_id").select("user_id", "last_ts", "event_id", "uses")


@query("events", oracle="select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) = 1 as newly_added from events")
def lru_first_use(events: DataFrame) -> DataFrame:
    """Whether a use adds its item to the queue."""
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first"))
    return events.join(first, "user_id").select("event_id", "user_id", "event_type", (F.col("event_id") == F.col("first")).alias("newly_added"))


@query("events", oracle="select event_id, ts, event_type from events order by ts desc, event_id desc limit 5")
def latest_five(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "ts", "event_type")


@query("part", oracle="select p_partkey, p_size, row_number() over (order by p_size desc, p_partkey) as place from part order by p_size desc, p_partkey limit 20 offset 10")
def page_of_rows(parts: DataFrame) -> DataFrame:
    """Skip and take: rows 11 to 30 of a page."""
    rows = parts.orderBy(F.desc("p_size"), "p_partkey").limit(30).select("p_partkey", "p_size")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p_size"), "p_partkey")).cast("long")).where("place > 10")


@query("orders", oracle=f"select o_custkey, o_orderkey, o_totalprice from (select *, {_RANK.format('asc')} as lo, {_RANK.format('desc')} as hi from orders) where lo > 2 and hi > 1")
def queue_after_removal(orders: DataFrame) -> DataFrame:
    """A double-ended queue per customer after its two least and its greatest are taken off."""
    return orderstats.without_ends(orders.select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 2, 1)


@query("orders", oracle="select o_custkey, quantile_disc(o_totalprice, 0.5) as median, min(o_totalprice) as least, max(o_totalprice) as greatest from orders where o_orderkey % 3 <> 0 group by o_custkey")
def median_after_removal(orders: DataFrame) -> DataFrame:
    """The median and both ends after some items are removed."""
    left = orderstats.without(orders.select("o_custkey", "o_totalprice", "o_orderkey"), orders.where("o_orderkey % 3 = 0"), ["o_custkey", "o_totalprice", "o_orderkey"])
    return left.groupBy("o_custkey").agg(orderstats.low_median("o_totalprice").alias("median"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("greatest"))


@query("events", oracle="select user_id, last_ts, event_id from (select user_id, max((ts, event_id)) as x, x[1] as last_ts, x[2] as event_id, arg_max(event_type, (ts, event_id)) as kind from events group by user_id) where kind <> 'error'")
def lru_after_removal(events: DataFrame) -> DataFrame:
    """The queue of recently used items when an error takes its user out until the next use."""
    return store.lru_left(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").withColumnRenamed("ts", "last_ts").select("user_id", "last_ts", "event_id")


@query_at(oracle="select l_returnflag as key, count(*) as result from lineitem group by 1")
def job_output_sink(spark, sf_dir: str) -> DataFrame:
    """The output of a job through a sink of one's own, read back from there."""
    at = f"{folder(spark).rstrip('/')}/job-{uuid.uuid4().hex[:12]}"
    job = mapreduce.Job(F.array(F.struct(F.col("l_returnflag").alias("key"), F.lit(1).alias("value"))), F.count("value"))
    job.run(files.table(spark, sf_dir, "lineitem"), store=lambda rows: rows.write.parquet(at))
    return spark.read.schema("key string, result long").parquet(at)


@query_at(oracle="select event_type, count(*) as seen from events group by event_type union all select 'none', 0")
def side_effects(spark, sf_dir: str) -> DataFrame:
    """A side effect for each row, counted where it happens; kinds without rows are told first."""
    events = files.table(spark, sf_dir, "events")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a fixed set of names
    out = []
    for kind in [*kinds, "none"]:
        rows = events.where(F.col("event_type") == kind)
        seen = spark.sparkContext.accumulator(0)
        if not rows.isEmpty():
            rows.select("event_id").foreachPartition(lambda part, seen=seen: seen.add(sum(1 for _ in part)))
        out.append((kind, seen.value))
    return spark.createDataFrame(out, "event_type string, seen long")
