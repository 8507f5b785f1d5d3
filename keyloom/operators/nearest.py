"""Nearest keys under XOR, and forward as-of joins, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import ids

def _prefixes(rows: DataFrame, id_col: str, depth: int, least: int = 0) -> DataFrame:
    """One row per row and length least .. depth with the id's first bits (its first limb must hold them)."""
    at = F.explode(F.sequence(F.lit(least), F.lit(depth)))
    return rows.withColumn("_p", at).withColumn("_bits", F.expr(f"shiftright(element_at({id_col}, 1), {ids.LIMB} - _p)"))


def _under_prefix(targets: DataFrame, nodes: DataFrame, depth: int, k: int) -> DataFrame:
    """(target, _id, node, _node): for each target the nodes under the longest prefix of its id under which there are ``k``.

    Lengths from 1 on are asked for by an equi-join; only a target that has too few nodes in its own half takes them all.
    """
    t = targets.select("target", F.col("node_id").alias("_id")).distinct()
    places = _prefixes(nodes.select("node", F.col("node_id").alias("_node")), "_node", depth)
    counts = places.where("_p > 0").groupBy("_p", "_bits").agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
    found = _prefixes(t, "_id", depth, 1).join(counts, ["_p", "_bits"]).groupBy("target", "_id").agg(F.max("_p").alias("_p"))
    best = t.join(found, ["target", "_id"], "left").withColumn("_p", F.coalesce("_p", F.lit(0)))
    best = best.withColumn("_bits", F.expr(f"shiftright(element_at(_id, 1), {ids.LIMB} - _p)"))
    return best.join(places, ["_p", "_bits"]).select("target", "_id", "node", "_node")


def owners(targets: DataFrame, nodes: DataFrame, depth: int = 24) -> DataFrame:
    """``targets`` with ``node``: the node of least XOR distance (``node_id`` of targets and nodes are id arrays).

    The nearest node is among those that share the longest prefix with the target.  With random ids a handful of nodes
    remain per target, whatever the number.
    """
    near = _under_prefix(targets, nodes, depth, 1)
    return near.groupBy("target").agg(F.min(F.struct(ids.xor(F.col("_id"), F.col("_node")).alias("d"), F.col("node")))["node"].alias("node"))


def closest_k(targets: DataFrame, nodes: DataFrame, k: int, depth: int = 24) -> DataFrame:
    """(target, node, distance, rank): the k nodes of least distance of each target.

    The nodes under a prefix of the target are all nearer than those outside it.  So the k nearest are among the nodes
    of the longest prefix under which there are at least k; an equi-join on (length, prefix) with the nodes' counts finds it, and only
    the nodes under it are compared.
    """
    pairs = _under_prefix(targets, nodes, depth, k).withColumn("distance", ids.xor(F.col("_id"), F.col("_node")))
    w = Window.partitionBy("target").orderBy("distance", "node")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("target", "node", "distance", "rank")


def bucket_order(targets: DataFrame, nodes: DataFrame, k: int, n: int) -> DataFrame:
    """The approximate order of routing tables: by how far a node's bucket is from the target's, then by distance.

    ``targets(target, node_id, owner_id)``.  The nodes of a bucket of an owner share a prefix with it, so buckets are counted
    per (owner, bucket); a target looks at the buckets around its own until they hold k, and at their nodes only.
    """
    own = targets.select("target", F.col("node_id").alias("_id"), F.col("owner_id").alias("_owner"))
    owners = own.select("_owner").distinct()
    level = F.explode(F.sequence(F.lit(0), F.lit(ids.LIMB)))
    # bucket b of an owner: the owner's first b bits, then the other bit; the last holds those that share the whole first limb
    seen = owners.withColumn("_b", level).withColumn("_p", F.least(F.col("_b") + 1, F.lit(ids.LIMB)))
    mine = F.expr(f"shiftright(element_at(_owner, 1), {ids.LIMB} - _p)")
    seen = seen.withColumn("_bits", F.when(F.col("_b") < ids.LIMB, mine.bitwiseXOR(F.lit(1).cast("long"))).otherwise(mine))
    places = nodes.select("node", F.col("node_id").alias("_node")).withColumn("_p", F.explode(F.sequence(F.lit(1), F.lit(ids.LIMB))))
    places = places.withColumn("_bits", F.expr(f"shiftright(element_at(_node, 1), {ids.LIMB} - _p)"))
    counts = places.groupBy("_p", "_bits").agg(F.count("*").alias("_n"))
    held = seen.join(counts, ["_p", "_bits"]).select("_owner", "_b", "_p", "_bits", "_n")
    middle = ids.prefix_length(ids.xor(F.col("_owner"), F.col("_id")), n)
    near = own.withColumn("_m", middle).join(held, "_owner").withColumn("_least", F.when(F.col("_b") == ids.LIMB, F.greatest(F.col("_b") - F.col("_m"), F.lit(0))).otherwise(F.abs(F.col("_b") - F.col("_m"))))
    # one row for each bucket of a target: at most 33
    before = F.sum(F.when(F.col("_b") < ids.LIMB, F.col("_n")).otherwise(0)).over(Window.partitionBy("target").orderBy("_least").rangeBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col("_before") < k) | (F.col("_b") == ids.LIMB))
    pairs = near.join(places, ["_p", "_bits"])
    bucket = ids.prefix_length(ids.xor(F.col("_owner"), F.col("_node")), n)
    pairs = pairs.withColumn("gap", F.abs(bucket - F.col("_m"))).withColumn("distance", ids.xor(F.col("_id"), F.col("_node")))
    w = Window.partitionBy("target").orderBy("gap", "distance", "node")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("target", "node", "gap", "rank")


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the first right row of the same ``by`` whose key is at or after its own, else of the last.

    Both sides are laid in one order and looked at once, so nothing is multiplied.
    """
    a = left.select(*by, F.col(left_key).alias("_k"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*by, F.col(right_key).alias("_k"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_k", "_side", "_v")
    after = F.first("_v", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    last = F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return a.unionByName(b).withColumn("_found", F.coalesce(after, last)).where("_side = 0").select("_row.*", F.col("_found").alias(value))
