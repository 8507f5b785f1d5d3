"""Queries of identifiers, hashes, stores, sketches and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import hashing, ids, text
from keyloom.operators import nearest, sketches, store
from keyloom.plans.base import query, query_at
from keyloom.sources import files


# ---- pieces of SQL for the oracles ----

def limbs_sql(x: str, n: int = 4) -> str:
    return "[" + ", ".join(f"('0x' || substr(md5(({x})::varchar), {8 * i + 1}, 8))::bigint" for i in range(n)) + "]"


def xor_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: xor(p[1], p[2]))"


def prefix_sql(d: str, n: int = 4) -> str:
    at = f"list_position(list_transform({d}, lambda v: v <> 0), true)"
    return f"(case when coalesce({at}, 0) = 0 then {32 * n} else 32 * ({at} - 1) + 32 - length(bin({d}[{at}])) end)::int"


def random_sql(seed: str, upper: str) -> str:
    s = f"(({seed}) & 4294967295)"
    t = f"xor({s}, ({s} << 11) & 4294967295)"
    return f"((xor({hashing.WORD ^ (hashing.WORD >> 19)}::bigint, xor({t}, {t} >> 8)) & {hashing.MASK31}) % ({upper}))"


def positions_sql(item: str, k: int, size: int) -> str:
    return "[" + ", ".join(random_sql(f"{item} + {i}", str(size)) for i in range(1, k + 1)) + "]"


# ---- identifiers ----

@query("supplier", oracle=f"select s_suppkey, distance[1] as d1, distance[4] as d4, rank from (select *, row_number() over (order by distance, s_suppkey) as rank from (select s_suppkey, {xor_sql(limbs_sql('s_suppkey'), limbs_sql(chr(39) + 'target' + chr(39)))} as distance from supplier)) where rank <= 10")
def xor_distance_topk(suppliers: DataFrame) -> DataFrame:
    """The ten nearest nodes of one target."""
    target = suppliers.sparkSession.range(1).select(F.lit(0).alias("target"), ids.md5_id(F.lit("target")).alias("node_id"))
    nodes = suppliers.select(F.col("s_suppkey").alias("node"), ids.md5_id(F.col("s_suppkey")).alias("node_id"))
    return nearest.closest_k(target, nodes, 10).select(F.col("node").alias("s_suppkey"), F.col("distance")[0].alias("d1"), F.col("distance")[3].alias("d4"), F.col("rank").cast("long"))


@query("customer", oracle=f"select c_custkey, {prefix_sql('d')} as bits from (select c_custkey, {xor_sql(limbs_sql('c_custkey'), limbs_sql('0'))} as d from customer)")
def common_prefix_length(customers: DataFrame) -> DataFrame:
    return customers.select("c_custkey", ids.prefix_length(ids.xor(ids.md5_id(F.col("c_custkey")), ids.md5_id(F.lit(0))), 4).alias("bits"))


@query("orders", "supplier", oracle=f"select o_orderkey, arg_min(s_suppkey, {xor_sql('o.i', 's.i')}) as owner from (select o_orderkey, {limbs_sql('o_orderkey')} as i from orders) o, (select s_suppkey, {limbs_sql('s_suppkey')} as i from supplier) s group by o_orderkey")
def owner_of_key(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The owner of each key, by a join on prefixes."""
    keys = orders.select(F.col("o_orderkey").alias("target"), ids.md5_id(F.col("o_orderkey")).alias("node_id"))
    nodes = suppliers.select(F.col("s_suppkey").alias("node"), ids.md5_id(F.col("s_suppkey")).alias("node_id"))
    return nearest.owners(keys, nodes).select(F.col("target").alias("o_orderkey"), F.col("node").alias("owner"))


@query("nation", "supplier", oracle=f"select n_nationkey, s_suppkey, r as rank from (select n_nationkey, s_suppkey, row_number() over (partition by n_nationkey order by {xor_sql('n.i', 's.i')}, s_suppkey) as r from (select n_nationkey, {limbs_sql('n_nationkey + 1000000')} as i from nation) n, (select s_suppkey, {limbs_sql('s_suppkey')} as i from supplier) s) where r <= 5")
def closest_nodes(nations: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Five nearest nodes of each of a fixed set of targets."""
    targets = nations.select(F.col("n_nationkey").alias("target"), ids.md5_id(F.col("n_nationkey") + 1000000).alias("node_id"))
    nodes = suppliers.select(F.col("s_suppkey").alias("node"), ids.md5_id(F.col("s_suppkey")).alias("node_id"))
    return nearest.closest_k(targets, nodes, 5).select(F.col("target").alias("n_nationkey"), F.col("node").alias("s_suppkey"), F.col("rank").cast("long"))


@query("nation", "supplier", oracle=f"""select n_nationkey, s_suppkey, gap, r as rank from (select *, row_number() over (partition by n_nationkey order by gap, d, s_suppkey) as r from (
    select n_nationkey, s_suppkey, {xor_sql('n.i', 's.i')} as d, abs({prefix_sql(xor_sql(limbs_sql('1'), 's.i'))} - {prefix_sql(xor_sql(limbs_sql('1'), 'n.i'))}) as gap
    from (select n_nationkey, {limbs_sql('n_nationkey + 1000000')} as i from nation) n, (select s_suppkey, {limbs_sql('s_suppkey')} as i from supplier) s)) where r <= 5""")
def closest_by_bucket(nations: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The approximate order of one node's own table."""
    targets = nations.select(F.col("n_nationkey").alias("target"), ids.md5_id(F.col("n_nationkey") + 1000000).alias("node_id"), ids.md5_id(F.lit(1)).alias("owner_id"))
    nodes = suppliers.select(F.col("s_suppkey").alias("node"), ids.md5_id(F.col("s_suppkey")).alias("node_id"))
    return nearest.bucket_order(targets, nodes, 5, 4).select(F.col("target").alias("n_nationkey"), F.col("node").alias("s_suppkey"), "gap", F.col("rank").cast("long"))


@query("supplier", oracle=f"select s_suppkey, {xor_sql(limbs_sql('s_suppkey'), limbs_sql('7'))} <= {xor_sql(limbs_sql('s_suppkey + 1'), limbs_sql('7'))} as first_closer from supplier")
def select_closer(suppliers: DataFrame) -> DataFrame:
    a, b = ids.md5_id(F.col("s_suppkey")), ids.md5_id(F.col("s_suppkey") + 1)
    return suppliers.select("s_suppkey", (ids.closer(a, b, ids.md5_id(F.lit(7))) == a).alias("first_closer"))


def _swap_sql(w: str) -> str:
    return "(" + " | ".join(f"(((({w}) >> {8 * i}) & 255) << {24 - 8 * i})" for i in range(4)) + ")"


@query("customer", oracle="select c_custkey, " + _swap_sql("c_custkey & 4294967295") + " as first_limb, " + _swap_sql("(c_custkey * 15) & 4294967295") + " as last_limb, 16 as n from customer")
def integer_keys(customers: DataFrame) -> DataFrame:
    k = ids.from_int(F.col("c_custkey"))
    return customers.select("c_custkey", k[0].alias("first_limb"), k[15].alias("last_limb"), F.size(k).alias("n"))


@query("customer")
def hashed_key(customers: DataFrame) -> DataFrame:
    """SHA-512 of an id's bytes (the oracle's SQL has no such digest)."""
    return customers.select("c_custkey", F.sha2(F.md5(F.col("c_custkey").cast("string").cast("binary")).cast("binary"), 512).alias("hashed"), ids.hashed(F.lit("x").cast("binary"))[0].alias("x_limb"))


@query("supplier", oracle="""select s_suppkey, list_reduce(list_prepend(0::bigint, list_transform(range(0, 16), lambda i: ('0x' || substr(md5(s_suppkey::varchar), 2 * i + 1, 2))::bigint)),
    lambda h, b: ((xor(h * 31, b) + 2147483648) & 4294967295) - 2147483648) as code from supplier""")
def id_hash_code(suppliers: DataFrame) -> DataFrame:
    digits = F.md5(F.col("s_suppkey").cast("string").cast("binary"))
    octets = F.array(*[F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("long") for i in range(16)])
    return suppliers.select("s_suppkey", ids.hash_code(octets).alias("code"))


@query("supplier", oracle="select s_suppkey, repeat(md5(s_suppkey::varchar), 4) as digits, 147 as shown from supplier")
def guid_round_trip(suppliers: DataFrame) -> DataFrame:
    digits = F.repeat(F.md5(F.col("s_suppkey").cast("string").cast("binary")), 4)
    return suppliers.select("s_suppkey", ids.from_guids(ids.as_guids(digits)).alias("digits"), F.length(ids.as_guids(digits)).alias("shown"))


@query("supplier", oracle="select s_suppkey, true as kept from supplier")
def refresh_ids(suppliers: DataFrame) -> DataFrame:
    """Ids for a bucket's refresh share the bucket's bits."""
    base, bits = ids.md5_id(F.col("s_suppkey")), (F.col("s_suppkey") % 100).cast("int")
    new = ids.with_prefix(base, ids.md5_id(F.col("s_suppkey") + 5), bits, 4)
    return suppliers.select("s_suppkey", (ids.prefix_length(ids.xor(base, new), 4) >= bits).alias("kept"))


def _advanced_sql(x: str, by: str) -> str:
    """Limbs of an id some places on, from SQL."""
    total, parts = f"({limbs_sql(x)})[4] + {by}", []
    for i in range(4, 0, -1):
        parts.append(f"(({total}) & 4294967295)")
        total = f"({limbs_sql(x)})[{i - 1}] + (({total}) >> 32)" if i > 1 else total
    return "[" + ", ".join(parts[::-1]) + "]"


@query("customer", oracle=f"select c_custkey, {_advanced_sql('c_custkey', '(c_custkey * 4294967291)')} as next from customer")
def advanced_ids(customers: DataFrame) -> DataFrame:
    """Ids some places on, with carry between limbs."""
    return customers.select("c_custkey", ids.advanced(ids.md5_id(F.col("c_custkey")), F.col("c_custkey") * 4294967291, 4).alias("next"))


_CHUNK_HEX = f"list_aggregate(list_transform({_advanced_sql('s_suppkey', 'i')}, lambda v: printf('%08x', v)), 'string_agg', '')"


@query("supplier", oracle=f"select s_suppkey, i as chunk, list_transform(range(0, 4), lambda n: ('0x' || substr(h, 8 * n + 1, 8))::bigint) as key from (select s_suppkey, i, md5(unhex({_CHUNK_HEX})) as h from supplier, range(0, 5) r(i))")
def chunk_keys(suppliers: DataFrame) -> DataFrame:
    """The keys of an object's chunks: the digest of its root's id advanced by the index."""
    rows = suppliers.select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("chunk"))
    return rows.select("s_suppkey", "chunk", ids.chunk_key(ids.md5_id(F.col("s_suppkey")), F.col("chunk")).alias("key"))


@query("customer", oracle="select c_custkey, list_transform(range(0, 4), lambda n: ('0x' || substr(md5(c_custkey || '/0'), 8 * n + 1, 8))::bigint) as id from customer")
def random_ids(customers: DataFrame) -> DataFrame:
    return customers.select("c_custkey", ids.random_id(F.col("c_custkey")).alias("id"))


@query("part", oracle="select p_partkey, list_transform(range(0, 16), lambda n: ('0x' || substr(rpad(hex(encode(p_name)), 128, '0'), 8 * n + 1, 8))::bigint) as id from part where strlen(p_name) <= 64")
def byte_ids(parts: DataFrame) -> DataFrame:
    """Ids from up to 64 bytes, with zeros on the right."""
    return parts.where(F.octet_length("p_name") <= 64).select("p_partkey", ids.from_bytes(F.col("p_name").cast("binary")).alias("id"))


@query("lineitem", oracle="""select l_orderkey, l_linenumber, least(greatest(l_quantity, 10), 40) as clamped, abs(l_quantity - 25) as gap, sign(l_quantity - 25)::int as side, round(pow(l_discount + 1, 3), 9) as cube,
    round(exp(l_tax), 9) as e, round(ln(l_extendedprice), 9) as l, floor(l_extendedprice)::bigint as whole, round(cos(l_quantity), 9) + 0.0 as c, round(sin(l_quantity), 9) + 0.0 as s from lineitem""")
def math_functions(lines: DataFrame) -> DataFrame:
    q = F.col("l_quantity")
    return lines.select("l_orderkey", "l_linenumber", F.least(F.greatest(q, F.lit(10)), F.lit(40)).alias("clamped"), F.abs(q - 25).alias("gap"), F.signum(q - 25).cast("int").alias("side"),
                        F.round(F.pow(F.col("l_discount") + 1, F.lit(3)), 9).alias("cube"), F.round(F.exp("l_tax"), 9).alias("e"), F.round(F.log("l_extendedprice"), 9).alias("l"),
                        F.floor("l_extendedprice").alias("whole"), (F.round(F.cos(q), 9) + 0.0).alias("c"), (F.round(F.sin(q), 9) + 0.0).alias("s"))


# ---- mixers and registers ----

@query("events", oracle=f"select event_id, {random_sql('event_id', '1000')} as r, floor({random_sql('event_id', '2147483648')} / 2147483648.0 * 1000)::bigint as scaled from events")
def static_random(events: DataFrame) -> DataFrame:
    return events.select("event_id", hashing.static_random(F.col("event_id"), 1000).alias("r"), hashing.scaled_random(F.col("event_id"), 1000).alias("scaled"))


_LFSR = "(s >> 1) | ((xor(xor(s, s >> 2), xor(s >> 3, s >> 5)) & 1) << 15)"


@query_at(oracle=f"with recursive r(step, s) as (select 0, 44257::bigint union all select step + 1, {_LFSR} from r where step < 300) select step, s as state from r where step > 0")
def lfsr16_sequence(spark, sf_dir: str) -> DataFrame:
    return spark.range(1, 301).select(F.col("id").cast("int").alias("step"), hashing.lfsr16(F.lit(44257), F.col("id").cast("int")).alias("state"))


@query_at(oracle=f"with recursive r(step, s, k) as (select 0, v::bigint, k from (values (4660, 'a'), (22136, 'b')) t(v, k) union all select step + 1, {_LFSR}, k from r where step < 100) select a.step, (a.s << 16) | b.s as state from r a join r b on a.step = b.step where a.k = 'a' and b.k = 'b' and a.step > 0")
def lfsr32_sequence(spark, sf_dir: str) -> DataFrame:
    return spark.range(1, 101).select(F.col("id").cast("int").alias("step"), hashing.lfsr32(F.lit(0x12345678), F.col("id").cast("int")).alias("state"))


@query("part", oracle="select p_partkey, list_aggregate(list_transform(range(0, 16), lambda i: (('0x' || substr(md5(p_name), 2 * i + 1, 2))::int)::varchar), 'string_agg', '.') as digest from part")
def block_digest(parts: DataFrame) -> DataFrame:
    """MD5 of a block as decimal bytes."""
    digits = F.md5(F.col("p_name").cast("binary"))
    return parts.select("p_partkey", F.concat_ws(".", *[F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10) for i in range(16)]).alias("digest"))


# ---- stores ----

@query("orders", "customer", oracle="select o_orderkey, c_name as value from orders left join customer on c_custkey = o_custkey and c_custkey % 5 <> 0")
def kv_lookup(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Point reads: null where the store has no such key."""
    kept = customers.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), F.lit(1).alias("seq"))
    got = store.KeyValueStore(kept).get(orders.select(F.col("o_custkey").alias("key"), "o_orderkey").select("key").distinct())
    return orders.select("o_orderkey", F.col("o_custkey").alias("key")).join(got, "key", "left").select("o_orderkey", "value")


@query("events", oracle="select user_id, event_type as value from (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 and event_type <> 'error'")
def kv_last_write_wins(events: DataFrame) -> DataFrame:
    """An error event deletes its key."""
    log = events.select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), "ts", "event_id")
    return store.current(log, "user_id", "value", ["ts", "event_id"])


@query("customer", oracle="select c_custkey as key, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then 'new' else c_mktsegment end as value from customer")
def kv_put_delete_get(customers: DataFrame) -> DataFrame:
    base = customers.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(1).alias("seq"))
    keys = base.select("key")
    put = keys.where("key % 3 = 1").select("key", F.lit("new").alias("value"), F.lit(2).alias("seq"))
    gone = keys.where("key % 3 = 0").select("key", F.lit(3).alias("seq"))
    return store.KeyValueStore(base).put(put).delete(gone).get(keys)


@query("events", oracle="select user_id, arg_max(value, event_id) filter (event_type <> 'view') as last_value, string_agg(event_type, '>' order by event_id) as types from events group by user_id")
def merge_records(events: DataFrame) -> DataFrame:
    """Scalars keep the last value, repeated fields are appended in order."""
    rows = events.select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("last_value"), F.array("event_type").alias("types"))
    return store.merged(rows, "user_id", ["event_id"], ["last_value"], ["types"]).withColumn("types", F.array_join("types", ">"))


@query("events", oracle="select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by user_id, event_type")
def latest_state(events: DataFrame) -> DataFrame:
    return store.latest(events, ["user_id", "event_type"], F.col("value"), ["ts", "event_id"])


# ---- sketches ----

BLOOM_K, BLOOM_SIZE = 4, 4093


def _item(c: str):
    return F.col(c) * 7919


@query("events", oracle=f"select pos, count(*) as cnt from (select unnest({positions_sql('user_id * 7919', BLOOM_K, BLOOM_SIZE)}) as pos from (select distinct user_id from events)) group by pos")
def bloom_positions(events: DataFrame) -> DataFrame:
    return sketches.Bloom.of(events.select("user_id").distinct(), _item("user_id"), BLOOM_K, BLOOM_SIZE).cells


_CELLS = f"(select distinct pos from (select unnest({positions_sql('user_id * 7919', BLOOM_K, BLOOM_SIZE)}) as pos from (select distinct user_id from events where event_type = 'purchase')))"


@query("customer", "events", oracle=f"select c_custkey, bool_and(pos in (select pos from {_CELLS})) as present from (select c_custkey, unnest({positions_sql('c_custkey * 7919', BLOOM_K, BLOOM_SIZE)}) as pos from customer) group by c_custkey")
def bloom_membership(customers: DataFrame, events: DataFrame) -> DataFrame:
    buyers = sketches.Bloom.of(events.where("event_type = 'purchase'").select("user_id").distinct(), _item("user_id"), BLOOM_K, BLOOM_SIZE)
    return buyers.contains(customers, "c_custkey", _item("c_custkey"))


@query("customer", "events", oracle="select c_custkey from customer where c_custkey in (select user_id from events where event_type = 'purchase')")
def bloom_then_exact(customers: DataFrame, events: DataFrame) -> DataFrame:
    """A semi-join whose left side a filter has thinned out first: no false positive is left."""
    buyers = events.where("event_type = 'purchase'").select("user_id").distinct()
    maybe = sketches.Bloom.of(buyers, _item("user_id"), BLOOM_K, BLOOM_SIZE).contains(customers, "c_custkey", _item("c_custkey")).where("present")
    return maybe.join(buyers, F.col("c_custkey") == F.col("user_id"), "left_semi").select("c_custkey")


@query("events", oracle="select event_type, n, round(pow(1 - exp(-4 * n / 4093.0), 4), 9) as rate from (select event_type, count(distinct user_id) as n from events group by 1)")
def bloom_fpr(events: DataFrame) -> DataFrame:
    n = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return n.withColumn("rate", F.round(sketches.false_positive_rate(F.col("n"), BLOOM_K, BLOOM_SIZE), 9))


def _cells_sql(where: str) -> str:
    return f"select unnest({positions_sql('user_id * 7919', BLOOM_K, BLOOM_SIZE)}) as pos from events where {where}"


@query("events", oracle=f"select pos, count(*)::bigint as cnt from (({_cells_sql(chr(39) + 'click' + chr(39) + ' = event_type')}) union all ({_cells_sql(chr(39) + 'view' + chr(39) + ' = event_type')})) group by pos")
def counting_bloom_union(events: DataFrame) -> DataFrame:
    def of(kind: str):
        return sketches.Bloom.of(events.where(F.col("event_type") == kind), _item("user_id"), BLOOM_K, BLOOM_SIZE)

    return of("click").union(of("view")).cells


@query("events", oracle=f"select pos, least(a.cnt, b.cnt) as cnt from (select pos, count(*) as cnt from ({_cells_sql(chr(39) + 'click' + chr(39) + ' = event_type')}) group by pos) a join (select pos, count(*) as cnt from ({_cells_sql(chr(39) + 'view' + chr(39) + ' = event_type')}) group by pos) b using (pos)")
def bloom_intersection(events: DataFrame) -> DataFrame:
    def of(kind: str):
        return sketches.Bloom.of(events.where(F.col("event_type") == kind), _item("user_id"), BLOOM_K, BLOOM_SIZE)

    return of("click").intersection(of("view")).cells


@query("events", oracle=f"select pos, count(*)::bigint as cnt from ({_cells_sql(chr(39) + 'click' + chr(39) + ' <> event_type')}) group by pos")
def counting_bloom_remove(events: DataFrame) -> DataFrame:
    full = sketches.Bloom.of(events, _item("user_id"), BLOOM_K, BLOOM_SIZE)
    return full.removed(events.where("event_type = 'click'"), _item("user_id")).cells


def _scaled_sql(seed: str, size: int) -> str:
    return f"floor({random_sql(seed, '2147483648')} / 2147483648.0 * {size})::bigint"


_FIRST = _scaled_sql("user_id * 7919", BLOOM_SIZE)


@query("events", oracle=f"select pos, count(*) as cnt from (select unnest([a, {_scaled_sql('a', BLOOM_SIZE)}]) as pos from (select {_FIRST} as a from events)) group by pos")
def iterated_bloom(events: DataFrame) -> DataFrame:
    """A counting filter of the scaling variant, in which each position is the seed of the next."""
    return sketches.Bloom.of(events, _item("user_id"), 2, BLOOM_SIZE, hashing.iterated_positions).cells


@query("events", oracle="""select user_id, user_id % 2 = 0 as removed from (select distinct user_id from events)""")
def bloom_try_remove(events: DataFrame) -> DataFrame:
    """Removal tells whether the item was there: only even users were added, to a filter too large for false positives."""
    users = events.select("user_id").distinct()
    even = sketches.Bloom.of(users.where("user_id % 2 = 0"), _item("user_id"), BLOOM_K, 1 << 30)
    left, known = even.removed_if_present(users, "user_id", _item("user_id"))
    return known.select("user_id", F.col("present").alias("removed"))


@query_at(oracle="select p, floor(-4093.0 / 4 * ln(1 - pow(p, 0.25)))::bigint as items from (values (0.001::double), (0.01::double), (0.1::double)) v(p)")
def bloom_capacity(spark, sf_dir: str) -> DataFrame:
    """How many items a filter holds at a rate of false positives."""
    empty = sketches.Bloom(spark.createDataFrame([], "pos long, cnt long"), BLOOM_K, BLOOM_SIZE)
    return spark.createDataFrame([(p, empty.capacity(p)) for p in (0.001, 0.01, 0.1)], "p double, items long")


# ---- text and records ----

@query("lineitem", oracle="""select l_orderkey, l_linenumber, case when v < 1024 then v::bigint::varchar || 'b' when v < 1048576 then round(v / 1024, 2)::decimal(20,2)::varchar || 'Kb'
    when v < 1073741824 then round(v / 1048576, 2)::decimal(20,2)::varchar || 'Mb' else round(v / 1073741824, 2)::decimal(20,2)::varchar || 'Gb' end as shown
    from (select l_orderkey, l_linenumber, (floor(l_extendedprice) * case when l_linenumber = 1 then 1 when l_linenumber = 2 then 100 else 1000000 end)::double as v from lineitem)""")
def size_format(lines: DataFrame) -> DataFrame:
    v = F.floor("l_extendedprice").cast("double") * F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 100).otherwise(1000000)
    return lines.select("l_orderkey", "l_linenumber", text.size_text(v).alias("shown"))


@query("events", oracle="select event_id, event_type as kind, user_id::varchar as who, 2 as n from events")
def switch_parse(events: DataFrame) -> DataFrame:
    """Even pieces are switches, the pieces after them their values; a last one without value is left out."""
    line = F.concat(F.lit("-type "), "event_type", F.lit(" -user "), F.col("user_id").cast("string"), F.lit(" -v"))
    m = text.switches(F.split(line, " "))
    return events.select("event_id", m["-type"].alias("kind"), m["-user"].alias("who"), F.size(m).alias("n"))


@query("part", oracle="select p_partkey, p_brand as first, p_type as second, 2 as n from part")
def quoted_arguments(parts: DataFrame) -> DataFrame:
    q = text.quoted(F.concat(F.lit('mute "'), "p_brand", F.lit('" and "'), "p_type", F.lit('"')))
    return parts.select("p_partkey", q[0].alias("first"), q[1].alias("second"), F.size(q).alias("n"))


@query("events", oracle="select kind, count(*) as n, sum(event_id)::bigint as ids from (select event_id, case event_type when 'view' then 'map' when 'click' then 'emit' when 'purchase' then 'result' else 'other' end as kind from events) group by kind")
def message_dispatch(events: DataFrame) -> DataFrame:
    """Messages told apart by a leading flag."""
    t = F.col("event_type")
    kind = F.when(t == "view", "map").when(t == "click", "emit").when(t == "purchase", "result").otherwise("other")
    return events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("events", oracle="select event_id, event_type from events where event_type not in ('view', 'error')")
def mute_filter(events: DataFrame) -> DataFrame:
    muted = events.sparkSession.createDataFrame([("view",), ("error",)], "event_type string")
    return files.unmuted(events, muted, "event_type").select("event_id", "event_type")


@query("customer", oracle="select c_custkey, len(list_concat([c_nationkey], [1, 2])) as n, list_concat([c_nationkey], [1, 2])[1] as head, list_append([c_nationkey], 9)[2] as last from customer")
def append_sequences(customers: DataFrame) -> DataFrame:
    a = F.array("c_nationkey")
    return customers.select("c_custkey", F.size(F.concat(a, F.array(F.lit(1), F.lit(2)))).cast("long").alias("n"), F.concat(a, F.array(F.lit(1), F.lit(2)))[0].alias("head"), F.array_append(a, F.lit(9))[1].alias("last"))


@query("part", oracle="select p_partkey, p_size::bigint as size, p_size::varchar as shown, p_retailprice::decimal(12, 2) as price from part")
def convert_types(parts: DataFrame) -> DataFrame:
    """A struct cast to a compatible struct."""
    s = F.struct("p_size", F.col("p_size").alias("s"), F.col("p_retailprice")).cast("struct<size: bigint, shown: string, price: decimal(12, 2)>")
    return parts.select("p_partkey", s.alias("x")).select("p_partkey", "x.*")


@query("events", oracle="""select event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' as message from events""")
def json_messages(events: DataFrame) -> DataFrame:
    return events.select("event_id", text.message(event_id=F.col("event_id"), kind=F.col("event_type")).alias("message"))


@query("documents")
def word_partitions(docs: DataFrame) -> DataFrame:
    """Words by the first byte of their partition id (UTF-16 digests: no oracle)."""
    words = docs.select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return words.groupBy(F.substring(text.partition_id(F.col("word")), 1, 2).alias("part")).agg(F.count("*").alias("n"))


@query("events", oracle="select event_id, ts as back, true as later from events")
def tick_round_trip(events: DataFrame) -> DataFrame:
    """Timestamps as ticks of 100 ns and back."""
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    ticks = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 10
    back = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("ticks") / 10_000_000).cast("decimal(18,6)"))
    return events.select("event_id", "ts", ticks.alias("ticks")).select("event_id", back.alias("back"), (F.col("ts") > start).alias("later"))
