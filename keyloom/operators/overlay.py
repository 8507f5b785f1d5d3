"""Routing tables as edges, and iterative closest-k lookups over them, all lookups at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import ids
from keyloom.operators.routes import Routes, starts_of
from keyloom.operators.shared import cut

BUCKET = 20
CONCURRENCY = 5
#: A lookup that is still open after so many rounds is an error.
MOST_ROUNDS = 64
#: Up to so many nodes travel to the tasks with their tables.
MOST_SENT = 2_000_000
#: What a contact may bring along: it does not answer; it takes a child.
FLAGS = ("dead", "accepts")


def _first_bits(n):
    """The first ``n`` (a Column, at least 1) bits of ``node_id``: whole limbs, then what is left of the next."""
    whole = ((n - 1) / ids.LIMB).cast("int")
    rest = F.call_function("shiftright", F.element_at("node_id", whole + 1), ids.LIMB - (n - ids.LIMB * whole))
    return F.slice("node_id", F.lit(1), whole), rest


def levels(nodes: DataFrame) -> int:
    """How many buckets from the first on can hold a contact, rounded up to bytes: no two different ids share more bits."""
    first = nodes.select(F.size("node_id").alias("n")).first()
    if first is None:
        return 1
    bits = ids.LIMB * first.n
    rows = nodes.select("node_id").distinct().withColumn("b", F.explode(F.sequence(F.lit(8), F.lit(bits), F.lit(8))))
    head, rest = _first_bits(F.col("b"))
    shared = rows.groupBy("b", head.alias("head"), rest.alias("rest")).agg(F.count("*").alias("n")).where("n > 1")
    return min((shared.agg(F.max("b")).first()[0] or 0) + 8, bits)


def edges(nodes: DataFrame, size: int = BUCKET) -> DataFrame:
    """(owner, owner_id, contact, contact_id, bucket) for ``nodes(node, node_id, added)``.

    Bucket b of an owner holds nodes that share exactly its first b bits: the first ``size`` to arrive.
    There are as many as the longest prefix that two nodes share asks for, over all limbs.
    They are picked once per prefix and joined by prefix, so no two nodes are compared.  Boolean columns named in FLAGS
    come along with the contact; dead nodes stay in the tables of others and have none themselves.
    """
    flags = [c for c in FLAGS if c in nodes.columns]
    level = nodes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(levels(nodes) - 1))))
    head, side = _first_bits(F.col("b") + 1)
    level = level.withColumn("head", head).withColumn("side", side)
    first = F.row_number().over(Window.partitionBy("b", "head", "side").orderBy("added", "node"))
    members = level.withColumn("r", first).where(F.col("r") <= size).select(
        "b", "head", "side", F.col("node").alias("contact"), F.col("node_id").alias("contact_id"), *flags)
    owners = (level.where("not dead") if "dead" in flags else level).select(F.col("node").alias("owner"), F.col("node_id").alias("owner_id"), "b", "head", F.col("side").bitwiseXOR(F.lit(1).cast("long")).alias("side"))
    return owners.join(members, ["b", "head", "side"]).select("owner", "owner_id", "contact", "contact_id", F.col("b").alias("bucket"), *flags)


def _steps(table: DataFrame, k: int, most: int) -> DataFrame:
    """(owner, b, contacts): among which the owner's k nearest to a target are that shares b bits with it.

    Nearest are the contacts in bucket b, then those in longer buckets, then shorter ones one by one; whole
    buckets are taken until there are k.
    """
    buckets = table.groupBy("owner", F.col("bucket").alias("j")).agg(F.collect_list(F.struct("contact", "contact_id", *[c for c in FLAGS if c in table.columns])).alias("c"))
    rows = buckets.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(most + 1))))
    far = F.when(F.col("j") >= F.col("b"), (F.col("j") > F.col("b")).cast("int")).otherwise(1 + F.col("b") - F.col("j"))
    before = F.sum(F.size("c")).over(Window.partitionBy("owner", "b").orderBy("far").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("far", far).withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.where(F.col("before") < k).groupBy("owner", "b").agg(F.flatten(F.collect_list("c")).alias("contacts"))


def lookup(asked: DataFrame, table: DataFrame, k: int = CONCURRENCY, until=None) -> DataFrame:
    """(lookup, rank, node, rounds) for ``asked(lookup, target_id, start, start_id)`` over ``edges``.

    Each round asks the nearest nodes not asked yet; each answers with the k contacts nearest to the target;
    the k nearest seen go on.  A dead contact gives no answer, which its asker learns by asking, and is passed over
    from then on.  A lookup ends when a round brings nothing new, when the target itself is found alive,
    when a node asked accepts, or when ``until`` (a Column over ``node_id`` and ``target_id``) holds for one of its nodes.
    One that has not ended after MOST_ROUNDS is an error.
    """
    flags = [F.col(c) if c in table.columns else F.lit(False).alias(c) for c in FLAGS]
    # nodes that have answered stay known where others may turn out to be dead
    known = F.col("asked") & F.lit("dead" in table.columns)
    table = cut(table.select("owner", "contact", "contact_id", "bucket", *flags))
    most = table.agg(F.max("bucket")).first()[0] or 0
    steps = cut(_steps(table, k, most))  # asked in every round
    failed = F.col("asked") & F.col("dead")
    near = Window.partitionBy("lookup").orderBy(failed, "d", "node")
    hit = F.forall("d", lambda x: x == 0) & ~F.col("dead") | F.col("asked") & F.col("accepts")
    if until is not None:
        hit = hit | until

    def kept(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(near)).where((F.col("rank") <= k) | known).drop("rank")
        return cut(ranked.withColumn("over", F.max(hit & ~failed).over(Window.partitionBy("lookup"))))

    state = asked.select("lookup", "target_id", F.col("start").alias("node"), F.col("start_id").alias("node_id"), F.lit(0).alias("rounds"),
                         F.lit(False).alias("asked"), *[F.lit(False).alias(c) for c in FLAGS])
    state = kept(state.withColumn("d", ids.xor(F.col("node_id"), F.col("target_id"))))
    for n in range(1, MOST_ROUNDS + 2):
        front = state.where("not asked and not over")
        if front.isEmpty():
            break
        if n > MOST_ROUNDS:
            raise RuntimeError(f"lookups are open after {MOST_ROUNDS} rounds")
        shared = F.least(ids.prefix_length(F.col("d"), ids.FULL_LIMBS), F.lit(most + 1))
        answers = front.where("not dead").select("lookup", "target_id", F.col("node").alias("owner"), shared.alias("b")).join(steps, ["owner", "b"])
        far = F.transform("contacts", lambda c: F.struct(ids.xor(c["contact_id"], F.col("target_id")).alias("d"), c["contact"].alias("node"), c["contact_id"].alias("node_id"), *[c[f].alias(f) for f in FLAGS]))
        answers = answers.select("lookup", "target_id", F.explode(F.slice(F.array_sort(far), 1, k)).alias("x"))
        new = answers.select("lookup", "target_id", "x.node", "x.node_id", F.lit(n).alias("rounds"), F.lit(False).alias("asked"), "x.d", *[f"x.{f}" for f in FLAGS])
        old = state.withColumn("asked", F.col("asked") | ~F.col("over")).drop("over")
        both = old.unionByName(new).groupBy("lookup", "target_id", "node", "node_id", "d").agg(F.min("rounds").alias("rounds"), *[F.max(c).alias(c) for c in ("asked", *FLAGS)])
        state = kept(both)
    out = state.withColumn("rank", F.row_number().over(near)).withColumn("rounds", F.max("rounds").over(Window.partitionBy("lookup")))
    return out.where(~failed & (F.col("rank") <= k)).select("lookup", "rank", "node", "rounds")


def _words(limbs: Column, n: int) -> list[Column]:
    """The 64-bit words of an id of ``n`` limbs, as signed bigints."""
    at = [F.get(limbs, F.lit(i)) if i < n else F.lit(0).cast("long") for i in range(n + n % 2)]
    return [F.shiftleft(at[i], ids.LIMB).bitwiseOR(at[i + 1]).alias(f"w{i // 2}") for i in range(0, len(at), 2)]


def _routes(nodes: DataFrame, k: int, bits: int | None) -> Routes | None:
    """The tables of ``edges(nodes)`` for lookups inside a task; None if they are too many or too much alike for that."""
    first = nodes.select(F.size("node_id").alias("n")).first()
    if first is None or nodes.schema["node"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint") or nodes.count() > MOST_SENT:
        return None
    dead = F.col("dead") if "dead" in nodes.columns else F.lit(False).alias("dead")
    words = _words(F.col("node_id"), first.n)
    rows = nodes.orderBy("added", "node").select(F.col("node").cast("long"), dead, *words).dropna(subset=["node", "w0"]).toArrow()
    if any(rows.column(i).null_count for i in range(rows.num_columns)):
        return None
    node, dead, *held = (c.to_numpy() for c in rows.columns)
    out = Routes(node, np.stack(held, axis=1).view(np.uint64), dead, BUCKET, k, bits)
    return out if out.fits else None


def lookups(asked: DataFrame, nodes: DataFrame, target: Column, k: int = CONCURRENCY, bits: int | None = None, best: int | None = None) -> DataFrame:
    """What ``lookup`` finds for ``asked(lookup, start)`` over the tables of ``edges(nodes)``, its first ``best`` ranks (None: all).

    ``target``, a Column over ``lookup``, is the id looked for; a start that is no living node asks nothing.  A lookup
    also ends when a node shares ``bits`` bits with its target.  Rows are dealt out once, by lookup, and each task takes its own from first to last
    round over all tables, which hold a few numbers a node.  Beyond MOST_SENT nodes, or where ids share very many bits, the
    tables are joined round by round, with the same results.
    """
    routes = _routes(nodes, k, bits)
    best, most = best or k, MOST_ROUNDS
    if routes is None or "accepts" in nodes.columns:
        alive = nodes.where("not dead") if "dead" in nodes.columns else nodes
        starts = asked.select("lookup", target.alias("target_id"), "start").join(alive.select(F.col("node").alias("start"), F.col("node_id").alias("start_id")), "start")
        near = None if bits is None else ids.prefix_length(F.col("d"), ids.FULL_LIMBS) >= bits
        return lookup(starts, edges(nodes), k, near).where(F.col("rank") <= best)
    sent = nodes.sparkSession.sparkContext.broadcast(vars(routes))  # plain arrays: tasks may not have this package
    width = routes.words.shape[1]
    dealt = asked.select("lookup", F.col("start").cast("long").alias("start")).repartition("lookup").sortWithinPartitions("lookup")
    kind, node = asked.schema["lookup"].dataType.simpleString(), nodes.schema["node"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        routes, held = Routes.of(sent.value), None

        def read(rows):
            key, words = rows.column(0), [rows.column(i) for i in range(2, 2 + width)]
            known = np.logical_and.reduce([pc.is_valid(w).to_numpy(zero_copy_only=False) for w in words])
            words = np.stack([pc.fill_null(w, 0).to_numpy() for w in words], axis=1).view(np.uint64)
            other = pc.fill_null(pc.not_equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False)
            null = pc.is_null(key).to_numpy(zero_copy_only=False)
            first = np.r_[True, other | (null[1:] != null[:-1])]
            place = np.where(pc.is_valid(rows.column(1)).to_numpy(zero_copy_only=False), routes.places(pc.fill_null(rows.column(1), 0).to_numpy()), -1)
            return np.flatnonzero(first), words, known, place, starts_of(routes, first, words[:, 0], known, place)

        def found(rows, first, words, known, place, row):
            some = row[:, 0] >= 0
            first, row = first[some], row[some]
            starts, known = np.where(row >= 0, place[row], -1), known[first]
            out, rounds = starts.copy(), np.zeros(len(first), np.int32)
            if known.any():
                out[known], rounds[known] = routes.lookups(words[first[known]], starts[known], most)
            out = out[:, :best]
            at, rank = np.nonzero(out >= 0)
            columns = [rows.column(0).take(pa.array(first[at])), (rank + 1).astype(np.int32), routes.node[out[at, rank]], rounds[at]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lookup", "rank", "node", "rounds"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.concat_batches([held, b])
            first, words, known, place, row = read(rows)
            last = int(first[-1])
            if last:
                yield found(rows, first[:-1], words, known, place, row[:-1])
            # of the last lookup more rows may follow: the starts that it would take so far, or any one of its rows
            keep = row[-1][row[-1] >= 0]
            held = rows.take(pa.array(keep if len(keep) else [last]))
        if held is not None:
            yield found(held, *read(held))

    out = dealt.select("lookup", "start", *_words(target, 2 * width)).mapInArrow(run, f"lookup {kind}, rank int, node long, rounds int")
    return out.withColumn("node", F.col("node").cast(node))


def churned(nodes: DataFrame, chance: float, seed: int) -> DataFrame:
    """``nodes`` with ``dead``: drawn from the seed and the node, the same in every run."""
    return nodes.withColumn("dead", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(10_000)) < int(chance * 10_000))


def replaced(nodes: DataFrame, chance: float, seed: int) -> DataFrame:
    """``nodes`` with ``dead``, and for each dead one a newcomer, which arrives after all others under an id of its own."""
    marked = churned(nodes.select("node", "node_id", "added"), chance, seed)
    last = marked.agg(F.max("node").alias("n"), F.max("added").alias("a")).first()
    width = len((nodes.select("node_id").first() or [[0] * 4])[0])
    new = marked.where("dead").select((F.col("node") + (last.n or 0) + 1).alias("node"), ids.random_id(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string")), width).alias("node_id"),
                                      (F.col("added") + (last.a or 0) + 1).alias("added"), F.lit(False).alias("dead"))
    return marked.unionByName(new)


def experiment(nodes: DataFrame, asked: DataFrame, target: Column, chances: list[float], seed: int = 5, k: int = CONCURRENCY) -> DataFrame:
    """(dead_share, nodes, dead, lookups, min_rounds, avg_rounds, max_rounds) for ``asked(lookup, start)``: a share of the nodes dies and is
    replaced by newcomers; the dead stay in the tables of others, and lookups from living nodes go round them."""
    parts, last = [], nodes.agg(F.max("node")).first()[0]
    asked = asked.where(F.col("start") <= F.lit(last))  # newcomers, whose numbers are above, ask nothing
    for chance in chances:
        everyone = replaced(nodes, chance, seed)
        n = everyone.agg(F.count("*").alias("all"), F.count_if("dead").alias("dead")).first()
        done = lookups(asked, everyone, target, k, best=1)
        parts.append(done.agg(F.lit(chance).alias("dead_share"), F.lit(n["all"]).alias("nodes"), F.lit(n["dead"]).alias("dead"), F.count("*").alias("lookups"),
                              F.min("rounds").alias("min_rounds"), F.round(F.avg("rounds"), 6).alias("avg_rounds"), F.max("rounds").alias("max_rounds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
