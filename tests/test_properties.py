"""Properties of the operators that no oracle shows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import hashing, ids, text
from keyloom.operators import fountain, mapreduce, nearest, orderstats, overlay, sketches, store
from keyloom.sources import files, records


def test_words_keep_other_marks(spark):
    df = spark.createDataFrame([(1, 'The cat, the "cat" - sat; on. A–b')], "doc_id int, text string")
    got = {r.word: r.n for r in mapreduce.word_count(df).collect()}
    assert got == {"the": 2, "cat": 2, "sat;": 1, "on": 1, "a–b": 1}


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_chunk_size_does_not_matter(spark, size):
    df = spark.createDataFrame([(1, "a b  a c a"), (2, ""), (3, "b")], "doc_id int, text string")
    whole = sorted(map(tuple, mapreduce.word_count(df).collect()))
    assert sorted(map(tuple, mapreduce.word_count(mapreduce.chunks(df, size), "words").collect())) == whole


def test_sort_is_an_ordered_permutation(spark):
    values = [random.Random(3).randrange(-(1 << 31), 1 << 31) for _ in range(1003)] + [50_000_000, -50_000_000, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r.v for r in mapreduce.total_sort(df, "v", partitions=7).collect()]
    assert got == sorted(values)
    ranks = mapreduce.ranked(df, ["v"]).collect()
    assert [r.v for r in sorted(ranks, key=lambda r: r["rank"])] == sorted(values)
    assert sorted(r["rank"] for r in ranks) == list(range(1, len(values) + 1))
    assert mapreduce.ranked(df.limit(0), ["v"]).count() == 0


def test_range_buckets_truncate_toward_zero(spark):
    got = spark.createDataFrame([(-60,), (-49,), (0,), (49,), (50,), (120,)], "v long").select(mapreduce.range_bucket(F.col("v"), 50).alias("b")).collect()
    assert [r.b for r in got] == [-50, 0, 0, 0, 50, 100]


def test_xor_is_a_metric(spark):
    df = spark.range(60).select(*[ids.md5_id(F.col("id") + i * 1000).alias(n) for i, n in enumerate("abc")])
    d = lambda x, y: ids.xor(F.col(x), F.col(y))
    row = df.select(F.bool_and(d("a", "b") == d("b", "a")).alias("same"), F.bool_and(ids.prefix_length(d("a", "a"), 4) == 128).alias("zero"),
                    F.bool_and(ids.prefix_length(d("a", "c"), 4) >= F.least(ids.prefix_length(d("a", "b"), 4), ids.prefix_length(d("b", "c"), 4))).alias("ultra")).first()
    assert tuple(row) == (True, True, True)


def test_ids_from_bytes(spark):
    df = spark.createDataFrame([(b"\x01\x02",), (b"",)], "b binary").select(ids.from_bytes(F.col("b"), 2).alias("i"))
    assert [r.i for r in df.collect()] == [[0x01020000, 0], [0, 0]]
    with pytest.raises(Exception, match="too many bytes"):
        spark.createDataFrame([(b"123456789",)], "b binary").select(ids.from_bytes(F.col("b"), 2)).collect()


def test_register_has_full_period(spark):
    row = spark.range(1).select(hashing.lfsr16(F.lit(1), F.lit(65535)).alias("s")).first()
    assert row.s == 1


def test_store_steps(spark):
    log = store.KeyValueStore(spark.createDataFrame([(1, "x", 1)], "key int, value string, seq int"))
    key = spark.createDataFrame([(1,)], "key int")
    assert log.get(key).first().value == "x"
    gone = log.delete(key.withColumn("seq", F.lit(2)))
    assert gone.get(key).first().value is None
    assert gone.put(spark.createDataFrame([(1, "y", 3)], "key int, value string, seq int")).get(key).first().value == "y"


def test_bloom_has_no_false_negatives(spark):
    items = spark.range(500)
    size, k = sketches.sized(500, 0.01)
    b = sketches.Bloom.of(items, F.col("id") * 31, k, size)
    assert b.contains(items, "id", F.col("id") * 31).where("not present").count() == 0
    assert b.removed(items, F.col("id") * 31).cells.count() == 0
    with pytest.raises(Exception, match="not in the filter"):
        b.removed(items, F.col("id") * 31).removed(items, F.col("id") * 31).union(b.removed(spark.range(1), F.col("id"))).removed(spark.range(600), F.col("id") * 31).cells.collect()


def test_fountain_decodes_what_is_left(spark):
    data = [(1, bytes(range(1, 101))), (2, b""), (3, b"x" * 40)]
    objects = spark.createDataFrame(data, "root long, data binary")
    packets = fountain.encode(objects, fountain.packets_of(objects, 4, 8.0), 4)
    got = {r.root: r for r in fountain.decode(packets, 4).collect()}
    assert all(got[k].complete and bytes(got[k].data) == v for k, v in data)
    few = {r.root: r for r in fountain.decode(packets.where("chunk_index < 2"), 4).collect()}
    assert not few[1].complete and few[1].data is None


def test_degrees_follow_the_soliton(spark):
    d = spark.range(20000).select(fountain.degree(F.col("id") * 7919, F.lit(25)).alias("d"))
    share = {r.d: r["count"] / 20000 for r in d.groupBy("d").count().collect()}
    assert abs(share[1] - 1 / 25) < 0.01 and abs(share[2] - 0.5) < 0.02 and abs(share[3] - 1 / 6) < 0.02 and max(share) <= 25


def md5_int(x) -> int:
    import hashlib

    return int(hashlib.md5(str(x).encode()).hexdigest(), 16)


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_nearest_nodes_match_brute_force(spark, n):
    keys = spark.range(200).select(F.col("id").alias("target"), ids.md5_id(F.col("id") + 5000).alias("node_id"), ids.md5_id(F.col("id") % 3).alias("owner_id"))
    nodes = spark.range(n).select(F.col("id").alias("node"), ids.md5_id(F.col("id")).alias("node_id"))
    ranked = {t: sorted(range(n), key=lambda i: md5_int(i) ^ md5_int(t + 5000)) for t in range(200)}
    assert {r.target: r.node for r in nearest.owners(keys, nodes).collect()} == {t: r[0] for t, r in ranked.items()}
    got = {(r.target, r["rank"]): r.node for r in nearest.closest_k(keys, nodes, 4).collect()}
    assert got == {(t, i + 1): x for t, r in ranked.items() for i, x in enumerate(r[:4])}

    def order(t, i):
        own, a, b = md5_int(t % 3), md5_int(t + 5000), md5_int(i)
        shared = [128 - (own ^ x).bit_length() for x in (a, b)]
        return abs(shared[0] - shared[1]), a ^ b, i

    got = {(r.target, r["rank"]): r.node for r in nearest.bucket_order(keys, nodes, 4, 4).collect()}
    assert got == {(t, i + 1): x for t in range(200) for i, x in enumerate(sorted(range(n), key=lambda i: order(t, i))[:4])}


def test_ranks_of_a_hot_group(spark):
    """One group with nearly all rows is ranked over several ranges."""
    rng = random.Random(5)
    rows = [("hot", rng.randrange(50)) for _ in range(4000)] + [("a", 3), ("b", 1), ("b", 2), (None, 7)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    values = {g: sorted(v for h, v in rows if h == g) for g, _ in rows}
    assert {r.g: r.high_median for r in orderstats.high_median(df, ["g"], "v").collect()} == {g: v[len(v) // 2] for g, v in values.items()}
    assert {r.g: r.kth for r in orderstats.kth_smallest(df, ["g"], "v", 1, ["v"]).collect()} == {g: v[1] for g, v in values.items() if len(v) > 1}
    left = orderstats.without_ends(df, ["g"], ["v"], 1, 1).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in left} == {g: len(v) - 2 for g, v in values.items() if len(v) > 2}


def test_running_median_in_order(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([None, *range(9)])) for g in ("a", "b", None) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(3)
    for r in orderstats.running_median(df, ["g"], ["i"], "v").collect():
        seen = sorted(v for g, i, v in rows if g == r.g and i <= r.i and v is not None)
        assert r.median == (seen[(len(seen) - 1) // 2] if seen else None)


def test_packed_and_joined_filters_agree(spark, monkeypatch):
    items = spark.range(300).withColumn("x", F.col("id") * 31)
    b = sketches.Bloom.of(items.where("id % 3 = 0"), F.col("x"), 3, 701)
    packed = sorted(map(tuple, b.contains(items, "id", F.col("x")).collect()))
    monkeypatch.setattr(sketches, "PACKED", 1)
    assert sorted(map(tuple, b.contains(items, "id", F.col("x")).collect())) == packed and sum(p for _, p in packed) >= 100
    none = sketches.Bloom.of(items.limit(0), F.col("x"), 3, 701)
    monkeypatch.setattr(sketches, "PACKED", 1000)
    assert none.contains(items, "id", F.col("x")).where("present").count() == 0


def lookup_by_hand(ids_of, tables, target, start, dead, accepts, k=5):
    """One lookup, as the rules say; the nodes it ends with, nearest first."""
    seen, asked = {start}, set()
    far = lambda n: (ids_of[n] ^ target, n)
    while True:
        alive = sorted((n for n in seen if not (n in asked and n in dead)), key=far)
        front = alive[:k]
        seen = set(front) | {n for n in seen if n in asked}
        if any(far(n)[0] == 0 and n not in dead or n in asked and n in accepts for n in front + [n for n in alive if n in asked]):
            return front
        new = [n for n in front if n not in asked]
        if not new:
            return front
        asked |= set(new)
        for n in new:
            if n not in dead:
                seen |= set(sorted(tables.get(n, []), key=far)[:k])


@pytest.mark.parametrize("chance, every", [(0.0, 0), (0.3, 0), (0.6, 0), (0.0, 4), (0.3, 4)])
def test_lookups_over_stale_tables(spark, chance, every):
    """Dead contacts stay in the tables; lookups end where those made by hand do."""
    nodes = spark.range(150).select(F.col("id").alias("node"), ids.md5_id(F.col("id")).alias("node_id"), F.col("id").alias("added"))
    everyone = overlay.replaced(nodes, chance, 3).withColumn("accepts", (F.col("node") % every == 0) if every else F.lit(False))
    rows = everyone.collect()
    dead, takes = {r.node for r in rows if r.dead}, {r.node for r in rows if r.accepts}
    assert len(rows) == 150 + len(dead) and (len(dead) > 0) == (chance > 0)
    ids_of = {r.node: int("".join(f"{x:08x}" for x in r.node_id), 16) for r in rows}
    assert len(set(ids_of.values())) == len(rows)
    table, tables = overlay.edges(everyone), {}
    for r in table.collect():
        tables.setdefault(r.owner, []).append(r.contact)
    assert not set(tables) & dead and (not dead or any(set(t) & dead for t in tables.values()))
    start = [r for r in rows if not r.dead][7]
    asked = spark.range(60).select(F.col("id").alias("lookup"), ids.md5_id(F.col("id") * 7).alias("target_id"), F.lit(start.node).cast("long").alias("start"), F.lit(start.node_id).alias("start_id"))
    got = {}
    for r in sorted(overlay.lookup(asked, table).collect(), key=lambda r: (r.lookup, r["rank"])):
        got.setdefault(r.lookup, []).append(r.node)
    for i in range(60):
        assert got[i][:1] and got[i] == lookup_by_hand(ids_of, tables, md5_int(i * 7), start.node, dead, takes)


def test_open_lookups_are_an_error(spark, monkeypatch):
    nodes = spark.range(80).select(F.col("id").alias("node"), ids.md5_id(F.col("id")).alias("node_id"), F.col("id").alias("added"))
    asked = nodes.select(F.col("node").alias("lookup"), F.reverse("node_id").alias("target_id"), F.col("node").alias("start"), F.col("node_id").alias("start_id"))
    monkeypatch.setattr(overlay, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="open after 1 rounds"):
        overlay.lookup(asked, overlay.edges(nodes)).count()


def test_word_partitions_and_hashed_keys(spark, data):
    """The two digests that the oracles' SQL lacks, by another library."""
    import hashlib

    from keyloom.plans import catalogue

    words = ["a", "word", "odd", "é日"]
    got = {r.w: r.p for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.partition_id(F.col("w")).alias("p")).collect()}
    for w in words:
        raw, back = w.encode("utf-16-le"), w[::-1]
        parts = [raw, str(len(raw)).encode(), back.encode("utf-16-le"), back[: -(-len(w) // 2)].encode("utf-16-le")]
        assert got[w] == "".join(hashlib.md5(p).hexdigest() for p in parts)
    for r in catalogue.QUERIES["hashed_key"](spark, data).limit(50).collect():
        inner = hashlib.md5(str(r.c_custkey).encode()).hexdigest().encode()
        assert r.hashed == hashlib.sha512(inner).hexdigest() and r.x_limb == int(hashlib.sha512(b"x").hexdigest()[:8], 16)


def test_reading_stops_at_many_misses(spark):
    objects = spark.createDataFrame([(1, bytes(range(1, 101)))], "root long, data binary")
    packets = fountain.encode(objects, fountain.packets_of(objects, 4, 8.0), 4)
    whole = fountain.fetch(packets, 4).first()
    assert whole.complete and not whole.gave_up and whole.fetched < packets.count() and bytes(whole.data) == bytes(range(1, 101))
    late = fountain.fetch(packets.where("chunk_index > 40"), 4, most_misses=40).first()
    assert late.gave_up and not late.complete and late.fetched == 0


def test_consumers(spark):
    from keyloom.streaming.pipes import Consumers

    got, c = [], Consumers()
    c.register("a", lambda rows: got.append(("a", rows.count())))
    assert c.get("b") is None and c.get_or_create("b", lambda: lambda rows: got.append(("b", rows.count()))) is c.get("b")
    with pytest.raises(ValueError, match="already"):
        c.register("a", print)
    c.deliver(spark.createDataFrame([("a",), ("a",), ("x",)], "kind string"), "kind")
    assert got == [("a", 2), ("b", 0)] and c.remove("a") and not c.remove("a")


def test_parents_accept(spark, data):
    from keyloom.plans import catalogue

    got = catalogue.QUERIES["parent_search"](spark, data).collect()
    n = spark.read.parquet(f"{data}/customer.parquet").count()
    assert len(got) == n and all(r.parent % 3 == 0 for r in got if r.parent is not None) and sum(r.parent is not None for r in got) > 0.9 * n


@pytest.mark.parametrize("n", [2, 5, 50])
def test_lookups_find_existing_nodes(spark, n):
    nodes = spark.range(n).select(F.col("id").alias("node"), ids.md5_id(F.col("id")).alias("node_id"), F.col("id").alias("added"))
    asked = nodes.select(F.col("node").alias("lookup"), F.col("node_id").alias("target_id"), F.lit(0).alias("start")).crossJoin(nodes.where("node = 0").select(F.col("node_id").alias("start_id")))
    got = {r.lookup: r.node for r in overlay.lookup(asked, overlay.edges(nodes)).where("rank = 1").collect()}
    assert got == {i: i for i in range(n)}


def test_edges_hold_every_prefix_length(spark):
    """Ids that share up to 127 bits: each bucket is there, as by brute force."""
    base = int.from_bytes(b"sixteen bytes id", "big")
    values = [base, *(base ^ (1 << (127 - b)) for b in (0, 3, 15, 16, 17, 31, 32, 33, 63, 64, 95, 96, 126, 127)), 5, 6]
    rows = [(i, [v >> s & 0xFFFFFFFF for s in (96, 64, 32, 0)], i) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "node long, node_id array<long>, added long")
    got = {(r.owner, r.contact, r.bucket) for r in overlay.edges(nodes).collect()}
    want = {(i, j, 128 - (a ^ b).bit_length()) for i, a in enumerate(values) for j, b in enumerate(values) if i != j}
    assert got == want


@pytest.mark.parametrize("k", [1, 5, 30])
def test_steps_hold_the_nearest_contacts(spark, k):
    """The contacts that a lookup looks at hold an owner's k nearest, for any target."""
    rng = random.Random(k)
    values = [rng.getrandbits(128) for _ in range(60)]
    near = [values[0] ^ (1 << n) for n in (5, 40, 90, 100)]
    rows = [(i, [v >> s & 0xFFFFFFFF for s in (96, 64, 32, 0)], i) for i, v in enumerate(values + near)]
    table = overlay.edges(spark.createDataFrame(rows, "node long, node_id array<long>, added long"))
    owned = {}
    for r in table.collect():
        owned.setdefault(r.owner, []).append(r.contact)
    most = table.agg(F.max("bucket")).first()[0]
    steps = {(r.owner, r.b): {c.contact for c in r.contacts} for r in overlay._steps(table, k, most).collect()}
    ids_of = values + near
    for owner, contacts in owned.items():
        for target in [rng.getrandbits(128), ids_of[owner] ^ rng.getrandbits(rng.randrange(1, 128)), ids_of[owner] ^ 1]:
            b = min(128 - (ids_of[owner] ^ target).bit_length(), most + 1)
            best = sorted(contacts, key=lambda c: ids_of[c] ^ target)[:k]
            assert set(best) <= steps[owner, b]


@pytest.mark.parametrize("name", ["iterative_lookup_hops", "iterative_lookup_nearest", "lookup_until_near", "churn_experiment"])
def test_every_order_is_looked_up(spark, data, name):
    """All order keys, and where the lookup runs to its end the nearest supplier by brute force."""
    import hashlib

    from keyloom.plans import catalogue

    orders = [r[0] for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()]
    got = catalogue.QUERIES[name](spark, data).collect()
    if name == "churn_experiment":
        assert {r.dead_share: r.lookups for r in got}[0.0] == len(orders)
        return
    assert {r.lookup for r in got} == set(orders)
    if name == "lookup_until_near":
        return
    nodes = {r[0]: int(hashlib.md5(str(r[0]).encode()).hexdigest(), 16) for r in spark.read.parquet(f"{data}/supplier.parquet").select("s_suppkey").collect()}
    first = {r.lookup: r.node for r in got if name == "iterative_lookup_nearest" or r["rank"] == 1}
    assert first == {o: min(nodes, key=lambda s: nodes[s] ^ int(hashlib.md5(str(o).encode()).hexdigest(), 16)) for o in orders}


@pytest.mark.parametrize("chance, bits, n, kind", [(None, None, 3, ""), (None, None, 700, ""), (None, 6, 700, ""), (0.0, None, 300, ""), (0.4, None, 300, ""), (0.4, 5, 300, ""), (0.6, None, 12, ""),
                                                   (None, None, 300, "close"), (0.4, None, 300, "close"), (None, 7, 300, "close"), (None, None, 60, "alike"), (0.3, None, 60, "alike")])
def test_lookups_in_tasks_are_those_by_joins(spark, monkeypatch, chance, bits, n, kind):
    """Nodes, ranks and rounds, from several starts too, with unknown starts, keys that repeat and keys that are null."""
    rng = random.Random(n)

    def limbs_of(i):
        v = rng.getrandbits(128)
        if kind == "close" and i % 4:  # most under few prefixes, so that buckets near a target overflow
            v = v >> (17 if i % 4 == 1 else 9) | (0 if i % 2 else 1 << 127)
        if kind == "alike" and i % 2:
            v = v >> 90
        return [v >> s & 0xFFFFFFFF for s in (96, 64, 32, 0)]

    nodes = spark.createDataFrame([(3 * i, limbs_of(i), rng.randrange(50)) for i in range(n)], "node long, node_id array<long>, added long")
    if chance is not None:
        nodes = overlay.replaced(nodes, chance, 3)
    nodes = nodes.localCheckpoint()
    keys = [(i if i % 40 else None, 3 * rng.randrange(n) + (i % 25 == 0)) for i in [*range(400), *range(0, 400, 3), *range(0, 60)]] + [(7, 3 * i) for i in range(n)]
    asked = spark.createDataFrame(keys, "lookup long, start long")
    some = {r.node: r.node_id for r in nodes.collect()}
    targets = spark.createDataFrame([(i, (some[3 * (i % n)] if i % 5 == 0 else limbs_of(i))) for i in range(400)], "lookup long, target_id array<long>").collect()
    target = F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in r.target_id]) for r in targets]), F.col("lookup").cast("int"))
    alive = nodes.where("not dead") if chance is not None else nodes
    near = None if bits is None else ids.prefix_length(F.col("d"), 4) >= bits
    starts = asked.distinct().withColumn("target_id", F.coalesce(target, F.array(*[F.lit(None).cast("long")] * 4))).join(alive.select(F.col("node").alias("start"), F.col("node_id").alias("start_id")), "start").localCheckpoint()
    want = sorted(map(tuple, overlay.lookup(starts, overlay.edges(nodes), until=near).select("lookup", "rank", "node", "rounds").collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        if kind != "alike":
            monkeypatch.setattr(overlay, "cut", None)  # no round is written out
        got = sorted(map(tuple, overlay.lookups(asked, nodes, F.coalesce(target, F.array(*[F.lit(None).cast("long")] * 4)), bits=bits).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 300 and got == want


@pytest.mark.parametrize("seed", range(8))
def test_lookups_of_arrays_are_those_one_by_one(seed):
    """Many lookups at once end as each does bucket by bucket, also where prefixes are crowded and nodes are dead."""
    import numpy as np

    from keyloom.operators.routes import Routes

    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 2000)), int(rng.integers(1, 9))
    words = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
    words[:, 0] = np.where(rng.random(n) < 0.6 * (seed % 2), words[:, 0] >> np.uint64(6), words[:, 0])
    dead = rng.random(n) < [0, 0.05, 0.4, 0.8][seed % 4]
    dead[0] = False
    routes = Routes(np.arange(n), words, dead, 20, k, 9 if seed > 5 else None)
    assert routes.fits
    target = rng.integers(0, 2**64, (150, 2), dtype=np.uint64)
    target[:30], target[30:80, 0] = words[rng.integers(0, n, 30)], target[30:80, 0] >> np.uint64(5)
    alive, starts = np.flatnonzero(routes.places(routes.node) >= 0), np.full((150, k), -1)
    for i in range(150):
        some = rng.choice(alive, min(len(alive), 1 + i % k), replace=False)
        starts[i, : len(some)] = some[np.argsort(routes.word[some] ^ target[i, 0])]
    out, rounds = Routes.of(vars(routes)).lookups(target, starts, 64)
    for i in range(150):
        best, n_rounds = routes._one([int(x) for x in target[i]], [int(x) for x in starts[i] if x >= 0], 64)
        assert out[i].tolist() == best + [-1] * (k - len(best)) and rounds[i] == n_rounds


@pytest.mark.parametrize("name", ["iterative_lookup_hops", "lookup_until_near", "iterative_lookup_nearest", "churn_experiment"])
def test_lookups_write_nothing_out(spark, data, monkeypatch, name):
    """Nothing a lookup sees goes to disk but its key and its start, once."""
    from keyloom.plans import catalogue

    monkeypatch.setattr(overlay, "cut", None)
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == (3 if name == "churn_experiment" else 1) and "Join" not in plan and "Window" not in plan


def test_newcomers_ask_nothing(spark):
    """A start that is no node at first asks nothing, though a newcomer may have its number later."""
    nodes = spark.range(20).select(F.col("id").alias("node"), ids.md5_id(F.col("id")).alias("node_id"), F.col("id").alias("added"))
    asked = spark.range(40).select(F.col("id").alias("lookup"), F.col("id").alias("start"))
    got = overlay.experiment(nodes, asked, ids.md5_id(F.col("lookup")), [0.5]).first()
    assert 0 < got.dead < 20 and got.lookups == 20 - got.dead


def test_lookup_without_nodes(spark):
    none = spark.createDataFrame([], "node long, node_id array<long>, added long")
    asked = spark.createDataFrame([], "lookup long, target_id array<long>, start long, start_id array<long>")
    assert overlay.lookup(asked, overlay.edges(none)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=20), st.sampled_from(records.STYLES), st.integers(1, 30))
def test_frames_round_trip(parts, style, tag):
    tag = tag if style == "base128" else None
    raw = b"".join(records.frame(p, style, tag) for p in parts)
    assert list(records.frames(raw, style, tag)) == parts


def test_frames_of_other_tags_are_skipped():
    raw = records.frame(b"a", "base128", 1) + records.frame(b"b", "base128", 2) + records.frame(b"c", "base128", 1)
    assert list(records.frames(raw, "base128", 1)) == [b"a", b"c"]
    with pytest.raises(ValueError, match="inside a record"):
        list(records.frames(b"\x05ab", "base128"))


def test_files_of_records(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(records.frame(b"x", "fixed32") + records.frame(b"", "fixed32"))
    (tmp_path / "two.bin").write_bytes(b"")
    assert sorted(bytes(r.record) for r in records.read_framed(spark, str(tmp_path), "fixed32").collect()) == [b"", b"x"]


def test_table_codec_carries_its_schema(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 2.5, None)], "i int, d double, s string")
    coded = records.encode_table(df.coalesce(1), "t")
    name, schema = records.table_schema(coded)
    assert name == "t" and schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, records.decode_table(coded, schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_contact_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("10.0.0.1 80 a\nbad line\n10.0.0.300 80 b\n1.2.3.4 x c\n1.2.3.4 70000 d\n1.2.3.4 1 e f\n")
    assert [tuple(r) for r in files.read_contacts(spark, str(tmp_path)).collect()] == [("10.0.0.1", 80, "a")]


def test_sizes_and_switches(spark):
    df = spark.createDataFrame([(10.0,), (2048.0,), (3.5 * 1024**2,), (2.0 * 1024**3,)], "n double")
    assert [r[0] for r in df.select(text.size_text(F.col("n"))).collect()] == ["10b", "2.00Kb", "3.50Mb", "2.00Gb"]
    m = spark.range(1).select(text.switches(F.array(*map(F.lit, ["-a", "1", "-b"]))).alias("m")).first().m
    assert m == {"-a": "1"}


def test_python_job_keeps_whole_bags(spark):
    df = spark.createDataFrame([("b a b",), ("a",), ("",)], "t string").repartition(2)
    got = mapreduce.python_job(df, ["t"], lambda t: [(w, len(w)) for w in t.split()], lambda k, vs: len(vs))
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 2)]


def test_entry_points(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
