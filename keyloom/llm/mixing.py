"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The tree has one level for each given column (domain, language, source).  A node's budget is dealt
to its children by weight; what a child cannot supply (its subtree's tokens times ``max_epochs``)
is dealt again to its siblings, by weight, and only what all of them together lack stays with the
parent's siblings.  Each leaf then takes whole epochs of its documents, and of the epoch after them
the prefix that fits, in an order drawn by hash from the seed and the epoch's number.

The prefix of a leaf is cut by sums over ranges of the hash, found some bits at a time, then by running
sums inside the one range where the cut falls, so no task holds a whole leaf or all its ranges.  Documents learn of it from a table of one
row per leaf, so their texts are not shuffled while that table is small enough to be sent along.

Defined cases: null and empty texts have no tokens, and come with the prefix in which they fall;
null levels are one group, named ''; a weight of 0 takes nothing; a leaf without tokens takes
nothing; rows of one doc_id in a leaf are taken together; an empty table gives no rows; other
columns are kept, but for those named like the two that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace

#: A word and the white space after it; the white space characters.
WORD, SPACES = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", " \t\n\x0b\x0c\r"
#: Rows in one range of a leaf's hash order, about; bits of a range's number that are settled at once.
RANGE_ROWS, STEP_BITS = 1024, 10


def n_words(text: Column) -> Column:
    """The number of words; each becomes one character, as a list of all words of a text would take much more memory."""
    marks = F.regexp_replace(F.ltrim(text.cast("string"), F.lit(SPACES)), WORD, "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def weight_of(col: Column, weights: dict[str, float] | None) -> Column:
    """The weight of a value of one level: 1 where none is given."""
    out = F.lit(1.0)
    for value, w in (weights or {}).items():
        out = F.when(col == value, F.lit(float(w))).otherwise(out)
    return out


def dealt(nodes: DataFrame, parent: list[str], names: list[str]) -> DataFrame:
    """``target`` of each node: its share of ``budget``, by ``weight``, up to ``capacity``.

    With the nodes in the order of capacity / weight, those at the front are full; the rest share
    what these leave, by weight.
    """
    order = [F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).asc_nulls_last(), *names]
    # a parent's children, one row each: small whatever the number of documents
    near = Window.partitionBy(*parent, "budget").orderBy(*order)
    front = F.coalesce(F.sum("capacity").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    back = F.sum("weight").over(near.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).withColumn(
        "level", F.when(back > 0, (F.col("budget") - front) / back))
    out = out.withColumn("full", F.col("capacity") <= F.col("weight") * F.col("level"))
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent, "budget"))
    target = F.when(F.col("weight") <= 0, 0.0).when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * rest)
    return out.withColumn("target", F.greatest(target, F.lit(0.0))).drop("level", "full")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict | None], budget: float, max_epochs: int) -> DataFrame:
    """(levels.., tokens, target) of each leaf of ``leaves(levels.., tokens)``."""
    above = None
    for depth in range(1, len(levels) + 1):
        names = levels[:depth]
        nodes = leaves.groupBy(*names).agg((F.sum("tokens") * max_epochs).cast("double").alias("capacity"))
        nodes = nodes.withColumn("weight", weight_of(F.col(names[-1]), weights[depth - 1]))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(float(budget)))
        else:
            nodes = nodes.join(above, names[:-1])
        above = dealt(nodes, names[:-1], names).select(*names, F.col("target").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "target"), levels)


def cuts_of(sums: DataFrame, names: list[str], bits: int, ws: Workspace) -> DataFrame:
    """(names.., part, before): the range in which each leaf's ``rest`` ends, and the tokens of the ranges before it.

    ``sums(names.., part, sum, rest)`` has a row for each range.  Its number is settled from the leading bits down,
    so a window holds ``2 ** STEP_BITS`` sums of a leaf, however many ranges there are.
    """
    run = Window.partitionBy(*names).orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if bits > STEP_BITS:
        sums = ws.save(sums, "sums")
    at = None
    for left in range((bits - 1) // STEP_BITS * STEP_BITS, -1, -STEP_BITS):
        here = sums.withColumn("before", F.lit(0).cast("long"))
        if at is not None:
            here = sums.join(at, names).where(F.shiftrightunsigned("part", left + STEP_BITS) == F.col("part_above")).drop("part_above")
        here = here.groupBy(*names, F.shiftrightunsigned("part", left).alias("head")).agg(
            F.sum("sum").alias("sum"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        here = here.withColumn("upto", F.col("before") + F.sum("sum").over(run)).where("upto > rest")
        here = here.groupBy(*names).agg(F.min(F.struct("head", (F.col("upto") - F.col("sum")).alias("before"))).alias("x"))
        at = ws.save(here.select(*names, F.col("x.head").alias("part_above"), F.col("x.before").alias("before")), "cut")
    return at.withColumnRenamed("part_above", "part")


def mixed(docs: DataFrame, levels: dict[str, Column], weights: list[dict | None], budget: float | None = None,
          share: float = 1.0, max_epochs: int = 1, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``epochs`` (how often a row is taken, 0 for not at all).

    ``budget`` is in tokens; without it, ``share`` of all tokens.  ``levels`` names the tree's
    columns from the top down; ``weights`` has one dict (or None) for each.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    names = [f"_level{i}" for i in range(len(levels))]
    tokens = n_words(F.col("text")) if tokens is None else tokens
    marked = docs.select("*", *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())])
    sized = ws.save(marked.select("doc_id", *names, tokens.alias("tokens")), "sized")
    leaves = ws.save(sized.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    total = leaves.agg(F.sum("tokens"), F.max("n")).first()
    want = share * (total[0] or 0) if budget is None else budget
    bits = max(1, ((total[1] or 0) // RANGE_ROWS).bit_length())
    plan = budgets(leaves, names, weights, want, max_epochs).withColumn("target", F.floor("target"))
    whole = F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(0))
    plan = ws.save(plan.withColumn("whole", whole).select(*names, "whole", (F.col("target") - F.col("whole") * F.col("tokens")).alias("rest")), "plan")
    def drawn(whole: str) -> Column:
        return F.xxhash64("doc_id", F.lit(seed), F.col(whole))

    part = F.shiftrightunsigned("h", 64 - bits)
    # of a leaf's rows only number, hash and size are dealt out; leaves are few, so the plan is mostly sent along
    rows = sized.join(plan.where("rest > 0"), names).withColumn("h", drawn("whole")).withColumn("part", part)
    sums = rows.groupBy(*names, "part").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    cut = cuts_of(sums, names, bits, ws)
    inside = rows.join(cut, [*names, "part"])
    upto = Window.partitionBy(*names).orderBy("h", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(upto)).where("upto <= rest")
    last = inside.groupBy(*names).agg(F.max(F.struct("h", "doc_id")).alias("last"))
    plan = plan.join(cut, names, "left").join(last, names, "left")
    plan = ws.save(plan.select(*names, F.col("whole").alias("_whole"), F.col("rest").alias("_rest"), F.col("part").alias("_part"), F.col("last.h").alias("_h"), F.col("last.doc_id").alias("_id")), "cuts")
    out = marked.join(plan, names).withColumn("_own", drawn("_whole"))
    own = F.shiftrightunsigned("_own", 64 - bits)
    inside = (own < F.col("_part")) | (own == F.col("_part")) & (F.struct(F.col("_own").alias("h"), F.col("doc_id").alias("i")) <= F.struct(F.col("_h").alias("h"), F.col("_id").alias("i")))
    taken = F.when((F.col("_rest") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    old = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "epochs")]
    return out.select(*old, tokens.alias("n_tokens"), (F.col("_whole") + taken).cast("int").alias("epochs"))
