"""Embedding near-dedup by lattice hashing: E8 cells of random projections, probed and verified.

Unit vectors are turned by random orthonormal bases; each table takes BLOCKS groups of eight of the new
coordinates, scaled so that two vectors at the threshold lie REACH apart in a group, and decodes each
group to its nearest E8 point.  Vectors of one label with equal points meet in a bucket; each vector also
probes, for each group, the cell behind the nearest wall.  Only names of cells are dealt out at first; the
vectors follow to cells where some meet.  Every pair that meets is verified by its cosine in double
precision.  A bucket with very many vectors is dealt as a grid of parts.

Tasks return spanning links, from which components are built, and how many links they found for each vector.
Two vectors may meet in several cells; a link counts in the least of them only, which both vectors' lists of cells
tell, so pairs are never written out, and nothing is compared but what met.  Equal vectors are one class with a count
throughout; a class is named by 64 bits of hash of its label and vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without
a label, link with nothing (no links, their own component, kept); vectors of different lengths never
link; repeated rows count as vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, by_key, components, dealt_as_grid, np_components, small_batches

TABLES, BLOCKS, REACH, SEED = 8, 3, 0.283, 8
HOT_CELL = 2048
PAIRS = 1 << 15
TASK_ROWS = 20_000


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, which point to the neighbours of a cell."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    for bits in range(256):
        signs = np.array([1 if bits >> k & 1 else -1 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(1)
    at = np.arange(len(odd))
    r[odd, worst] += np.where(gap[at, worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of D8, or of D8 moved by a half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


_BASES: dict = {}


def projection(dim: int, tables: int) -> np.ndarray:
    """Rows of random orthonormal bases, as many as the tables need."""
    if (dim, tables) not in _BASES:
        rng, rows = np.random.default_rng(SEED + dim), []
        while sum(map(len, rows)) < tables * BLOCKS * 8:
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            rows.append((q * np.sign(np.diag(r))).T)
        _BASES[dim, tables] = np.concatenate(rows)[: tables * BLOCKS * 8]
    return _BASES[dim, tables]


def cell_keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of lattice points (doubled, so whole numbers)."""
    h = salt.astype(np.uint64)
    for c in np.rint(points * 2).astype(np.int64).T:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(units: np.ndarray, labels: np.ndarray, min_cosine: float, tables: int):
    """(key, role, row) of the home cells (role 0) and probed cells (role 1) of unit vectors of one length."""
    n, dim = units.shape
    apart = np.sqrt(2 - 2 * min_cosine) * np.sqrt(8 / dim)
    y = units @ projection(dim, tables).T * (REACH / apart)
    v = shortest()
    row = np.arange(n)
    for t in range(tables):
        salt = labels.astype(np.int64).view(np.uint64) * np.uint64(1 << 20) + np.uint64(dim * 64 + t)
        groups = [y[:, 8 * (t * BLOCKS + g) : 8 * (t * BLOCKS + g + 1)] for g in range(BLOCKS)]
        home = [nearest_e8(g) for g in groups]
        yield cell_keys(np.concatenate(home, 1), salt), np.zeros(n, np.int32), row
        for g in range(BLOCKS):
            beyond = home[g] + v[((groups[g] - home[g]) @ v.T).argmax(1)]
            yield cell_keys(np.concatenate([*home[:g], beyond, *home[g + 1 :]], 1), salt), np.ones(n, np.int32), row


def vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x, np.float64) for x in column.to_numpy(zero_copy_only=False)]


def unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pairs_within(key: np.ndarray, side: np.ndarray, own: np.ndarray, dim: np.ndarray, units: list[np.ndarray], min_cosine: float, role: np.ndarray):
    """Blocks (i, j) of linked positions of one key; sorted by (key, side).  Two probes don't meet; rows of a task that is
    not its ``own`` meet those of the other side only."""
    n = len(key)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lo, hi = new, np.concatenate((new[1:], [n]))
    two = np.concatenate(([0], np.cumsum(side)))
    mid = hi - (two[hi] - two[lo])
    x = np.zeros((n, dim.max() if n else 0))
    for i, u in enumerate(units):
        x[i, : len(u)] = u
    # of each position: the later ones of its key, or those of the other side
    group = np.repeat(np.arange(len(lo)), hi - lo)
    at = np.arange(n)
    begin = np.where(own, at + 1, mid[group])
    count = np.where(own | (side == 0), np.maximum(0, hi[group] - begin), 0)
    upto = np.cumsum(count)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        size = count[first:last]
        i = np.repeat(at[first:last], size)
        j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        first = last
        meet = (dim[i] == dim[j]) & ((role[i] == 0) | (role[j] == 0))
        i, j = i[meet], j[meet]
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], j[s : s + PAIRS]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= min_cosine
            if near.any():
                yield a[near], b[near]


def least_meeting(homes: np.ndarray, probes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least cell in which the vectors at ``i`` and ``j`` meet: one is at home there, the other too or looks at it."""
    none = np.iinfo(np.int64).max
    out = np.full(len(i), none)
    for a, b, x, y in ((homes, homes, i, j), (homes, probes, i, j), (homes, probes, j, i)):
        for c in range(a.shape[1]):
            mine = a[x, c]
            out = np.minimum(out, np.where((b[y] == mine[:, None]).any(1), mine, none))
    return out


def near_duplicates(rows: DataFrame, min_cosine: float = 0.98, tables: int = TABLES, hot: int = HOT_CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``rows(vec_id, embedding, label)``."""
    spark = rows.sparkSession
    ws = Workspace(spark, "lattice")
    small_batches(spark, 2048)
    # floats stay floats on their way; their cosines are taken in double precision
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v"), F.col("label").cast("long").alias("label"))
    fit = F.coalesce(
        F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(fit).withColumn("node", F.xxhash64("label", "v"))
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.xxhash64("label", "v"))

    def place(batches):
        for b in batches:
            label, vs = b.column(0).to_numpy(), vectors(b.column(1))
            length = np.array([len(x) for x in vs])
            homes, probes = np.zeros((len(vs), tables), np.int64), np.zeros((len(vs), tables * BLOCKS), np.int64)
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                h = p = 0
                for key, role, _ in cells(unit([vs[i] for i in at]), label[at], min_cosine, tables):
                    if role[0]:
                        probes[at, p], p = key, p + 1
                    else:
                        homes[at, h], h = key, h + 1
            both = [pa.array(list(x), pa.list_(pa.int64())) for x in (homes, probes)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (2, 3, 4, 1)), *both], names=["node", "first", "n", "v", "homes", "probes"])

    classes = classes.select("label", "v", "node", "first", "n").mapInArrow(place, f"node long, first long, n long, v array<{kind}>, homes array<long>, probes array<long>")
    classes = ws.save(classes, "classes")
    seen = F.concat(F.transform("homes", lambda k: F.struct(k.alias("top"), F.lit(True).alias("home"))), F.transform("probes", lambda k: F.struct(k.alias("top"), F.lit(False).alias("home"))))
    placed = classes.select("node", F.explode(seen).alias("x")).select("x.top", "x.home", "node")
    # a cell that only one vector is in or looks at, or that is nobody's home, needs no task
    live = ws.save(placed.groupBy("top").agg(F.count("*").alias("n"), F.bool_or("home").alias("h")).where("n > 1 and h").select("top", "n"), "cells")
    met = ws.save(placed.join(live.select("top"), "top"), "met")
    placed = met.join(classes.select("node", F.col("n").alias("copies"), "v", "homes", "probes"), "node").withColumn("role", (~F.col("home")).cast("int"))
    placed = dealt_as_grid(placed.withColumn("same", F.lit(True)).withColumn("side", F.lit(0)).withColumn("cell", F.col("top")), hot, ws, live)
    placed = placed.select("key", "side", "own", "cell", "role", "node", "copies", "v", "homes", "probes").repartition("key").sortWithinPartitions("key", "side")

    def verify(batches):
        for t in by_key(batches, TASK_ROWS):
            key, side, own, cell, role, node, copies = (t.column(i).to_numpy() for i in range(7))
            vs = vectors(t.column(7))
            homes, probes = (np.stack(t.column(i).to_numpy()) for i in (8, 9))
            dim = np.array([len(x) for x in vs])
            label, links = np.arange(len(key)), np.zeros(len(key), np.int64)
            for i, j in pairs_within(key, side, own, dim, [unit([x])[0] for x in vs], min_cosine, role):
                label = np_components(len(key), i, j, label)
                here = least_meeting(homes, probes, i, j) == cell[i]
                i, j = i[here], j[here]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
            child, some = np.flatnonzero(node != node[label]), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]]), pa.array(np.zeros(len(child), np.int64))], names=["a", "b", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], names=["a", "b", "links"])

    found = ws.save(placed.mapInArrow(verify, "a long, b long, links long"), "links")
    member = components(spark, found.where("b is not null").select("a", "b").distinct(), ws)
    member = ws.save(member.join(classes.select("node", "first"), "node"), "members")
    least = ws.save(member.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    ids = member.select("node", "root").join(least, "root").select("node", "component_id")
    known = classes.select("node", "n", "first").join(links, "node", "left").join(ids, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    known = ws.save(known, "known")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", "node").join(known, "node").select("vec_id", "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
