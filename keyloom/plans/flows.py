"""Queries of ordered events, codes, routing tables, codecs, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import control, ids
from keyloom.operators import fountain, nearest, overlay, sequences
from keyloom.operators.shared import folder
from keyloom.plans.base import micros, query, query_at
from keyloom.plans.keys import limbs_sql, prefix_sql, xor_sql
from keyloom.sources import files, records
from keyloom.streaming import pipes

HOUR = 3_600_000_000


# ---- ordered events ----

@query("supplier", oracle="select s_suppkey, idx, round(cos(idx / n * 2 * pi()), 6) + 0.0 as x, round(sin(idx / n * 2 * pi()), 6) + 0.0 as y from (select s_suppkey, row_number() over (order by md5(s_suppkey::varchar)) - 1 as idx, count(*) over () as n from supplier)")
def ring_layout(suppliers: DataFrame) -> DataFrame:
    return sequences.ring_layout(suppliers.select("s_suppkey"), F.md5(F.col("s_suppkey").cast("string").cast("binary")))


@query("events", oracle="""select event_id, run, run >= 3 as tripped from (select event_id, sum(fail) over (partition by user_id, island order by ts, event_id rows unbounded preceding)::bigint as run from
    (select *, (event_type in ('error', 'view'))::int as fail, sum((event_type not in ('error', 'view'))::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events))""")
def failure_islands(events: DataFrame) -> DataFrame:
    failed = F.col("event_type").isin("error", "view")
    return sequences.failure_runs(events, ["user_id"], ["ts", "event_id"], failed, 3).select("event_id", "run", "tripped")


@query("events", oracle="select event_id, misses from (select event_id, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as misses from events) where misses <= 5")
def misses_so_far(events: DataFrame) -> DataFrame:
    return sequences.misses_so_far(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 5).select("event_id", "misses")


@query("events", oracle="""select user_id, grp, n, round(amount, 4) as amount, round(case when secs > 0 then amount / secs end, 9) as rate from
    (select user_id, grp, n, amount, (epoch_us(fin) - lag(epoch_us(fin)) over (partition by user_id order by grp)) / 1e6 as secs from
    (select user_id, grp, count(*) as n, sum(value) as amount, max(ts) as fin from (select *, ((row_number() over (partition by user_id order by ts, event_id) - 1) // 11)::bigint as grp from events) group by user_id, grp))""")
def rate_per_window(events: DataFrame) -> DataFrame:
    """Rates over every 11 frames."""
    out = sequences.rates(events, ["user_id"], ["ts", "event_id"], micros(), F.col("value"))
    return out.withColumn("amount", F.round("amount", 4)).withColumn("rate", F.round("rate", 9))


@query("events", oracle="select event_id, round(value - coalesce(lag(value) over (partition by user_id order by ts, event_id), 0), 6) as delta from events")
def sample_deltas(events: DataFrame) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("event_id", F.round(F.col("value") - F.coalesce(before, F.lit(0.0)), 6).alias("delta"))


_THROTTLED = f"""with recursive e as (select user_id, epoch_us(ts) as t from events), acc(user_id, t) as (
    select user_id, min(t) as t from e group by user_id
    union all
    select a.user_id, (select min(e.t) from e where e.user_id = a.user_id and e.t > a.t + {24 * HOUR}) as t from acc a
    where exists (select 1 from e where e.user_id = a.user_id and e.t > a.t + {24 * HOUR}))
    """


@query("events", oracle=_THROTTLED + "select user_id, t from acc")
def throttle_frames(events: DataFrame) -> DataFrame:
    """Frames more than a day after the last accepted one."""
    return sequences.throttled(events.withColumn("m", micros()), ["user_id"], F.col("m"), 24 * HOUR)


@query("events", oracle="""select event_id, child in (select c2 from (select user_id % 7 as p, user_id as c2, row_number() over (partition by user_id % 7 order by min((ts, event_id)), user_id) as place from events group by 1, 2) where place <= 2 and p = parent) as accepted
    from (select event_id, user_id % 7 as parent, user_id as child from events)""")
def admission_two_children(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", (F.col("user_id") % 7).alias("parent"), F.col("user_id").alias("child"), "ts")
    return sequences.admitted(rows, ["parent"], "child", ["ts", "event_id"], 2).select("event_id", "accepted")


@query("events", oracle="""select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from
    (select *, (ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hours or lag(ts) over (partition by user_id order by ts, event_id) is null)::int as new from events)) group by user_id, s""")
def inactivity_sessions(events: DataFrame) -> DataFrame:
    """Sessions that six hours without an event end."""
    s = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query("events", oracle="select event_id, user_id from (select *, max((ts, event_id)) filter (event_type = 'error') over (partition by user_id) as mark from events) where mark is null or (ts, event_id) > mark")
def clear_after_control(events: DataFrame) -> DataFrame:
    return sequences.after_last(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id")


@query("events", oracle="""with c as (select user_id, event_id as click_id, ts from events where event_type = 'click'), p as (select user_id, event_id as buy_id, ts from events where event_type = 'purchase')
    select c.click_id, coalesce((select min((p.ts, p.buy_id)) from p where p.user_id = c.user_id and p.ts >= c.ts), (select max((p.ts, p.buy_id)) from p where p.user_id = c.user_id))[2] as buy_id from c""")
def asof_forward(events: DataFrame) -> DataFrame:
    """For each click the next purchase of its user, else the last one."""
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), "ts")
    return nearest.asof_forward(clicks, buys, ["user_id"], "ts", "ts", "buy_id").select("click_id", "buy_id")


@query("events", oracle="select o.user_id, o.event_id as open_id, c.event_id as close_id from events o join events c on o.user_id = c.user_id and c.ts >= o.ts and c.ts <= o.ts + interval 1 day where o.event_type = 'signup' and c.event_type = 'purchase'")
def lookup_correlation(events: DataFrame) -> DataFrame:
    o = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("open_id"), F.col("ts").alias("t0"))
    c = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("close_id"), F.col("ts").alias("t1"))
    return o.join(c, "user_id").where("t1 >= t0 and t1 <= t0 + interval 1 day").select("user_id", "open_id", "close_id")


@query("events", oracle="select user_id, event_id from events o where event_type = 'signup' and not exists (select 1 from events c where c.event_type = 'purchase' and c.user_id = o.user_id and c.ts >= o.ts and c.ts <= o.ts + interval 1 day)")
def unanswered_requests(events: DataFrame) -> DataFrame:
    """Requests that no response matches within a day."""
    asked = events.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("t0"))
    answers = events.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("t1"))
    return asked.join(answers, F.expr("user_id = u and t1 >= t0 and t1 <= t0 + interval 1 day"), "left_anti").select("user_id", "event_id")


@query("events", oracle="""select user_id, list_reduce(list_prepend(50::bigint, list(floor(value * 3)::bigint - 100 order by ts, event_id)), lambda q, d: least(greatest(q + sign(d) * case when abs(d) > 100 then 2 else 1 end, 0), 101)::bigint)::int as quality from events group by user_id""")
def quality_controller(events: DataFrame) -> DataFrame:
    """A fold over each stream's differences."""
    d = (F.floor(F.col("value") * 3) - 100).cast("long")
    s = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", d.alias("d")))), lambda x: x["d"]).alias("ds"))
    return s.select("user_id", control.quality(F.col("ds"), 50, 100).alias("quality"))


@query("events", oracle="select event_id, sum((value > 90)::int) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as dropped_before from events qualify value <= 90")
def oversize_drop(events: DataFrame) -> DataFrame:
    """Frames that fit, each with the number of those dropped so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("dropped_before", F.sum((F.col("value") > 90).cast("int")).over(w)).where("value <= 90").select("event_id", "dropped_before")


# ---- codes ----

@query_at(oracle="select b as blocks, k, round(1.0 / b + 1 - 1.0 / k, 9) as share from range(1, 41) t(k), (values (40), (100)) v(b)")
def soliton_cdf(spark, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 41).select(F.explode(F.array(F.lit(40), F.lit(100))).alias("blocks"), F.col("id").alias("k"))
    return rows.select("blocks", "k", F.round(fountain.soliton_cdf(F.col("k"), F.col("blocks")), 9).alias("share"))


def _draw_sql(seed: str, block: str) -> str:
    u = f"((({seed}) * 48271 + (({block}) + 1) * 69621) % {fountain.PRIME})"
    v = f"(({u} * {u} + {seed}) % {fountain.PRIME})"
    return f"(({v} * {v} + ({block})) % {fountain.PRIME})"


_U = f"({_draw_sql('seed', f'{fountain.OWN_DRAW}::bigint')} % {fountain.GRID} / {fountain.GRID}.0)"
_DEGREE = f"(case when {_U} < 1.0 / k then 1 else least(ceil(1 / (1 + 1.0 / k - {_U})), k) end)::int"
_DRAW = _draw_sql("d.seed", "b.block")
_PARTS = "(select p_size::bigint as root, row_number() over (partition by p_size order by p_partkey) - 1 as block, p_partkey as value, count(*) over (partition by p_size) as k from part)"


@query("part", oracle=f"""with b as {_PARTS}, p as (select root, k, i as chunk_index, root * 1000 + i as seed from (select distinct root, k from b), range(0, 10) r(i)),
    d as (select *, {_DEGREE} as degree from p),
    c as (select d.*, b.value, row_number() over (partition by d.root, d.chunk_index order by {_DRAW}, b.block) as place from d join b on b.root = d.root)
    select root, chunk_index, degree, bit_xor(value) as word from c where place <= degree group by root, chunk_index, degree""")
def fountain_encode_xor(parts: DataFrame) -> DataFrame:
    """Packets over the part keys of a size, each a XOR of the blocks that its seed names."""
    w = Window.partitionBy("root").orderBy("p_partkey")
    blocks = parts.select(F.col("p_size").cast("long").alias("root"), "p_partkey").select("root", (F.row_number().over(w) - 1).alias("block"), F.col("p_partkey").alias("value"))
    packets = blocks.groupBy("root").agg(F.count("*").alias("k")).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("seed", F.col("root") * 1000 + F.col("chunk_index"))
    sets = packets.withColumn("blocks", fountain.block_set(F.col("seed"), F.col("k"))).withColumn("degree", F.size("blocks"))
    wide = sets.select("root", "chunk_index", "degree", F.explode("blocks").alias("block")).join(blocks, ["root", "block"])
    return wide.groupBy("root", "chunk_index", "degree").agg(F.bit_xor("value").alias("word")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


BLOCK, MULTIPLE = 64, 3.0
_ROOT = "p_size + 64L * (p_partkey div 4000L)"
_ROOT_SQL = "(p_size + 64 * (p_partkey // 4000))::bigint"
_OCTETS = "(sum(strlen(p_name)) + count(*) - 1)"


def _objects(parts: DataFrame) -> DataFrame:
    """One object for each part size and stretch of part keys: the names of its parts, a bounded number of them."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), ";")
    return parts.groupBy(F.expr(_ROOT).alias("root")).agg(names.cast("binary").alias("data"))


#: How many packets per block a reader may ask for before it gives up.
ENOUGH = 12.0


@query("part", oracle=f"select {_ROOT_SQL} as root, true as complete, greatest(1, ceil({_OCTETS} / {BLOCK}.0))::int as solved, true as equal from part group by 1")
def fountain_roundtrip(parts: DataFrame) -> DataFrame:
    """Objects encoded, every seventh packet lost, and decoded: they equal the input."""
    objects = _objects(parts)
    packets = fountain.encode(objects, fountain.packets_of(objects, BLOCK, ENOUGH), BLOCK)
    got = fountain.decode(packets.where("chunk_index % 7 <> 3"), BLOCK)
    return got.join(objects.select("root", F.col("data").alias("wanted")), "root").select("root", "complete", "solved", F.coalesce(F.col("data") == F.col("wanted"), F.lit(False)).alias("equal"))


@query("part", oracle=f"select {_ROOT_SQL} as root, true as complete, false as gave_up, md5(string_agg(p_name, ';' order by p_partkey)) as digest from part group by 1")
def erasure_get(parts: DataFrame) -> DataFrame:
    """Objects read packet by packet until they can be decoded; every seventh packet is missing."""
    objects = _objects(parts)
    packets = fountain.encode(objects, fountain.packets_of(objects, BLOCK, ENOUGH), BLOCK).where("chunk_index % 7 <> 3")
    return fountain.fetch(packets, BLOCK).select("root", "complete", "gave_up", F.md5("data").alias("digest"))


@query("part", oracle=f"select {_ROOT_SQL} as root, (floor(ceil({_OCTETS} / {BLOCK}.0) * {MULTIPLE} + 1) + 4)::bigint // 7 as repaired, true as equal from part group by 1")
def erasure_repair(parts: DataFrame) -> DataFrame:
    """Lost packets made again from the object, equal to those that were lost."""
    objects = _objects(parts)
    expected = fountain.packets_of(objects, BLOCK, MULTIPLE)
    stored = fountain.encode(objects, expected, BLOCK)
    lost = fountain.missing(expected, stored.where("chunk_index % 7 <> 2"))
    again = fountain.encode(objects, lost, BLOCK).select("root", "chunk_index", F.col("words").alias("again"))
    return again.join(stored, ["root", "chunk_index"]).groupBy("root").agg(F.count("*").alias("repaired"), F.bool_and(F.col("again") == F.col("words")).alias("equal"))


@query("part", oracle=f"""with o as (select {_ROOT_SQL} as root, greatest(1, ceil({_OCTETS} / {BLOCK}.0))::bigint as k from part group by 1),
    p as (select root, k, i as chunk_index, root * 1000 + i as seed from o, lateral (select unnest(range(0, k + 1)) as i)),
    d as (select *, {_DEGREE} as degree from p), b as (select root, unnest(range(0, k)) as block from o),
    c as (select d.root, d.chunk_index, d.degree, b.block, row_number() over (partition by d.root, d.chunk_index order by {_DRAW}, b.block) as place from d join b on b.root = d.root),
    f as (select root, block, min(chunk_index) as first from c where place <= degree group by 1, 2)
    select p.root, p.chunk_index::int as chunk_index, count(*) filter (f.first <= p.chunk_index) as named, p.k as blocks from p left join f on f.root = p.root group by p.root, p.chunk_index, p.k""")
def fountain_progress(parts: DataFrame) -> DataFrame:
    """How many blocks the packets so far name, packet by packet."""
    objects = _objects(parts)
    sets = fountain.packets_of(objects, BLOCK, 1.0).withColumn("blocks", fountain.block_set(F.col("seed"), F.col("block_count")))
    return fountain.progress(sets).groupBy("root", "chunk_index").agg(F.count_if("done").alias("named"), F.count("*").alias("blocks"))


# ---- routing tables ----

def _nodes(suppliers: DataFrame) -> DataFrame:
    return suppliers.select(F.col("s_suppkey").alias("node"), ids.md5_id(F.col("s_suppkey")).alias("node_id"), F.col("s_suppkey").alias("added"))


_PAIRS = f"(select a.s_suppkey as owner, b.s_suppkey as contact, {prefix_sql(xor_sql('a.i', 'b.i'))} as bucket from (select s_suppkey, {limbs_sql('s_suppkey')} as i from supplier) a, (select s_suppkey, {limbs_sql('s_suppkey')} as i from supplier) b where a.s_suppkey <> b.s_suppkey)"


@query("supplier", oracle=f"select owner, bucket, count(*) as n, sum(contact)::bigint as contacts from (select *, row_number() over (partition by owner, bucket order by contact) as r from {_PAIRS}) where r <= 20 group by owner, bucket")
def bucket_histogram(suppliers: DataFrame) -> DataFrame:
    """Buckets of all routing tables: the first 20 contacts to arrive."""
    return overlay.edges(_nodes(suppliers)).groupBy("owner", "bucket").agg(F.count("*").alias("n"), F.sum("contact").alias("contacts"))


def _target() -> Column:
    """The id that a lookup looks for."""
    return ids.md5_id(F.col("lookup"))


def _keys(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    """A lookup for every order key, from a node drawn by the customer's key."""
    n, low = nodes.agg(F.count("*"), F.min("node")).first()
    return orders.select(F.col("o_orderkey").alias("lookup"), (F.pmod("o_custkey", F.lit(n)) + low).alias("start"))


def _asked(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    keys = _keys(orders, nodes).withColumn("target_id", _target())
    return keys.join(nodes.select(F.col("node").alias("start"), F.col("node_id").alias("start_id")), "start")


@query("orders", "supplier")
def iterative_lookup_hops(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Iterative lookups over the routing tables: nodes found and rounds taken."""
    nodes = _nodes(suppliers)
    return overlay.lookups(_keys(orders, nodes), nodes, _target())


@query("orders", "supplier", oracle=f"select o_orderkey as lookup, arg_min(s_suppkey, {xor_sql('o.i', 's.i')}) as node from (select o_orderkey, {limbs_sql('o_orderkey')} as i from orders) o, (select s_suppkey, {limbs_sql('s_suppkey')} as i from supplier) s group by 1")
def iterative_lookup_nearest(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The nearest node that each lookup ends with is the owner."""
    nodes = _nodes(suppliers)
    return overlay.lookups(_keys(orders, nodes), nodes, _target(), best=1).select("lookup", "node")


@query("orders", "supplier")
def lookup_until_near(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Lookups that end early, once a node shares ten bits with the target."""
    nodes = _nodes(suppliers)
    return overlay.lookups(_keys(orders, nodes), nodes, _target(), bits=10)


@query("orders", "supplier")
def churn_experiment(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Rounds of lookups with shares of the nodes dead."""
    nodes = _nodes(suppliers)
    return overlay.experiment(nodes, _keys(orders, nodes), _target(), [0.0, 0.2, 0.5])


@query("supplier")
def dead_nodes(suppliers: DataFrame) -> DataFrame:
    return overlay.churned(_nodes(suppliers), 0.3, 11).select("node", "dead")


@query("customer", "supplier")
def parent_search(customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Each customer looks for a parent near its own id; the search ends at the first node that takes a child."""
    nodes = _nodes(suppliers).withColumn("accepts", F.col("node") % 3 == 0)
    asked = _asked(customers.select(F.col("c_custkey").alias("o_orderkey"), F.col("c_custkey").alias("o_custkey")), nodes)
    found = overlay.lookup(asked, overlay.edges(nodes))
    return found.groupBy("lookup").agg(F.min(F.when(F.col("node") % 3 == 0, F.struct("rank", "node")))["node"].alias("parent"), F.max("rounds").alias("rounds"))


# ---- codecs, sources and sinks ----

@query("events", oracle="select event_id, user_id, event_type from events")
def length_prefix_roundtrip(events: DataFrame) -> DataFrame:
    """Rows as JSON records in length-prefixed streams, and back."""
    as_json = events.select(F.to_json(F.struct("event_id", "user_id", "event_type")).cast("binary").alias("r"))
    back = records.unframed(records.framed(as_json, "r", "base128", tag=1), "stream", "base128", tag=1)
    return back.select(F.from_json(F.col("record").cast("string"), "event_id long, user_id long, event_type string").alias("x")).select("x.*")


@query("events", oracle="select style, count(*) as n, sum(event_id)::bigint as ids from events, (values ('fixed32'), ('fixed32be')) v(style) group by style")
def fixed_prefix_roundtrip(events: DataFrame) -> DataFrame:
    parts = []
    for style in records.STYLES[1:]:
        raw = events.select(F.col("event_id").cast("string").cast("binary").alias("r"))
        back = records.unframed(records.framed(raw, "r", style), "stream", style)
        parts.append(back.agg(F.lit(style).alias("style"), F.count("*").alias("n"), F.sum(F.col("record").cast("string").cast("long")).alias("ids")))
    return parts[0].unionByName(parts[1])


@query_at(oracle="select event_id, event_type from events")
def log_playback(spark, sf_dir: str) -> DataFrame:
    """A log of length-prefixed messages in files, played back some files at a time."""
    at = _place(spark, "messages")
    events = files.table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type")).cast("binary").alias("r"))
    records.write_framed(events.repartition(6), "r", at)
    back = records.playback(spark, at, step=2)
    return pipes.finished(back.select(F.from_json(F.col("record").cast("string"), "event_id long, event_type string").alias("x")).select("x.*"))


@query("orders", oracle="select o_orderkey, case when o_custkey % 4 <> 0 then o_orderstatus end as status, o_orderdate, o_totalprice::decimal(14, 2) as price from orders")
def table_codec_roundtrip(orders: DataFrame) -> DataFrame:
    """A table with nulls through its self-describing form."""
    rows = orders.select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderstatus")).alias("status"), "o_orderdate", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    return records.decode_table(records.encode_table(rows, "orders"), rows.schema)


@query("supplier", oracle="select '10.0.' || (s_suppkey % 256) || '.' || (s_suppkey % 200) as ip, (1000 + s_suppkey)::int as port, md5(s_suppkey::varchar) as id from supplier where s_suppkey % 10 not in (3, 7)")
def contacts_parse(suppliers: DataFrame) -> DataFrame:
    """Lines 'ip port id'; those that don't parse are left out."""
    k = F.col("s_suppkey").cast("string")
    ip = F.concat(F.lit("10.0."), (F.col("s_suppkey") % 256).cast("string"), F.lit("."), (F.col("s_suppkey") % 200).cast("string"))
    port = F.when(F.col("s_suppkey") % 10 == 3, "no-port").otherwise((F.col("s_suppkey") + 1000).cast("string"))
    line = F.when(F.col("s_suppkey") % 10 == 7, F.concat_ws(" ", ip, port)).otherwise(F.concat_ws(" ", ip, port, F.md5(k.cast("binary"))))
    return files.parsed_contacts(suppliers.select(line.alias("value")))


def _place(spark, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query_at(oracle="select (l_suppkey % 50)::int as tables, count(*) filter (l_returnflag = 'R')::int as dead, min(l_linenumber) as min, round(avg(l_quantity), 6) as avg, max(l_linenumber) as max, count(*) as total_lookups from lineitem group by 1")
def metrics_csv_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Metric rows through a headerless CSV."""
    at, lines = _place(spark, "metrics"), files.table(spark, sf_dir, "lineitem")
    rows = lines.groupBy((F.col("l_suppkey") % 50).cast("int").alias("tables")).agg(F.count_if(F.col("l_returnflag") == "R").cast("int").alias("dead"), F.min("l_linenumber").alias("min"), F.round(F.avg("l_quantity"), 6).alias("avg"), F.max("l_linenumber").alias("max"), F.count("*").alias("total_lookups"))
    files.write_metrics(rows, at)
    return files.read_csv(spark, at, files.METRICS)


@query_at(oracle="select day, event_type, count(*) as n from (select cast(ts as date) as day, event_type from events) group by day, event_type")
def log_by_date(spark, sf_dir: str) -> DataFrame:
    """A log in a folder for each day; the days are read from the folders."""
    at, events = _place(spark, "log"), files.table(spark, sf_dir, "events")
    files.write_log(events.select("event_id", "event_type", "ts"), at, F.to_date("ts"))
    return spark.read.schema("event_id long, event_type string, day date").json(at).groupBy("day", "event_type").agg(F.count("*").alias("n"))


@query_at(oracle="select o_orderkey, count(l_orderkey) as n, coalesce(sum(l_quantity), 0)::double as units from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def nested_file_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Nested orders through gzipped Parquet."""
    at = _place(spark, "nested")
    nested = files.nested_orders(files.table(spark, sf_dir, "orders").select("o_orderkey"), files.table(spark, sf_dir, "lineitem"))
    files.write_compressed(nested, at)
    back = spark.read.parquet(at)
    return back.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.aggregate("lines.l_quantity", F.lit(0.0), lambda s, x: s + x), F.lit(0.0)).alias("units"))


# ---- streams ----

@query_at(oracle="select event_type, count(*) as n from events group by event_type")
def stream_counts(spark, sf_dir: str) -> DataFrame:
    return pipes.finished(pipes.counts(pipes.events(spark, sf_dir), ["event_type"]), "complete")


@query_at(oracle="select event_id, event_type from events where event_type not in ('view', 'error')")
def stream_mute(spark, sf_dir: str) -> DataFrame:
    return pipes.finished(pipes.muted(pipes.events(spark, sf_dir).select("event_id", "event_type"), ["view", "error"], "event_type"))


@query_at(oracle=_THROTTLED + "select a.user_id, min(e.event_id) as event_id from acc a join events e on e.user_id = a.user_id and epoch_us(e.ts) = a.t group by a.user_id, a.t")
def stream_throttle(spark, sf_dir: str) -> DataFrame:
    return pipes.finished(pipes.throttled(pipes.events(spark, sf_dir), "user_id", 24 * HOUR))


@query_at(oracle="select p as parent, c as child from (select user_id % 7 as p, user_id as c, row_number() over (partition by user_id % 7 order by min((ts, event_id)), user_id) as place from events group by 1, 2) where place <= 2")
def stream_admission(spark, sf_dir: str) -> DataFrame:
    rows = pipes.events(spark, sf_dir).select((F.col("user_id") % 7).alias("parent"), F.col("user_id").alias("child"), "event_id", "at")
    return pipes.finished(pipes.admitted(rows, "parent", "child", 2))


@query_at(oracle="""select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from
    (select *, (ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hours or lag(ts) over (partition by user_id order by ts, event_id) is null)::int as new from events)) group by user_id, s""")
def stream_sessions(spark, sf_dir: str) -> DataFrame:
    """Sessions of a stream; a heartbeat at its end closes the last ones."""
    end = files.table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("interval 8 hours")).cast("string")).first()[0]
    beaten = pipes.with_heartbeat(pipes.events(spark, sf_dir), "at", end, "user_id")
    out = pipes.finished(pipes.sessions(beaten, "user_id", "6 hours", "1 hour")).where("user_id is not null")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query_at(oracle="select event_type, count(*) as n, sum(event_id)::bigint as ids from events where event_type in ('click', 'view') group by event_type")
def consumer_dispatch(spark, sf_dir: str) -> DataFrame:
    """Messages of a stream go to the consumers that are registered for their kind; one is removed before it starts."""
    at, consumers = _place(spark, "consumed"), pipes.Consumers()

    def writer(kind: str):
        return lambda rows: rows.select("event_type", "event_id").write.mode("append").parquet(f"{at}/{kind}")

    for kind in ("click", "view", "error"):
        consumers.get_or_create(kind, lambda: writer(kind))
    consumers.remove("error")
    consumers.run(pipes.events(spark, sf_dir), "event_type")
    got = spark.read.schema("event_type string, event_id long").parquet(f"{at}/click", f"{at}/view")
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query_at(oracle="select o.user_id, o.event_id as open_id, c.event_id as close_id from events o join events c on o.user_id = c.user_id and c.ts >= o.ts and c.ts <= o.ts + interval 1 day where o.event_type = 'signup' and c.event_type = 'purchase'")
def stream_correlation(spark, sf_dir: str) -> DataFrame:
    """Opens and closes as two streams; both sides' state goes once the watermark has passed."""
    e = pipes.events(spark, sf_dir)
    return pipes.finished(pipes.correlated(e.where("event_type = 'signup'"), pipes.events(spark, sf_dir).where("event_type = 'purchase'"), "user_id", "1 day", "1 hour"))


@query_at(oracle="select event_id, s_suppkey as child from events join supplier on s_nationkey = user_id % 25 where event_type = 'signup'")
def stream_fan_out(spark, sf_dir: str) -> DataFrame:
    """Each frame once for each child: a stream joined with a static table."""
    children = files.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("parent"), F.col("s_suppkey").alias("child"))
    frames = pipes.events(spark, sf_dir).where("event_type = 'signup'").select("event_id", (F.col("user_id") % 25).alias("parent"))
    return pipes.finished(pipes.fan_out(frames, children, "parent")).select("event_id", "child")
