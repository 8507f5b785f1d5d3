"""SimHash near-dedup: fingerprints, and a binary trie self-join under a Hamming budget.

Search.  The 64 bits are cut into ``blocks``; of two fingerprints that differ in at most
``radius`` bits, some block differs in at most ``radius // blocks`` bits.  For each block there
is one trie, whose leading bits are that block: the join walks pairs of its nodes together, adds
up the bits in which they differ, and drops a pair once the leading block's budget (inside that
block) or the whole budget is exceeded.  The top of a trie is dealt out as tasks, one for each
pair of top nodes within budget.  A node with very many fingerprints is dealt further down: the bits under it are cut
into blocks again, one of which has no errors, and there is a trie for each that goes on with that block; what is
still very many there is dealt as a grid of parts.  A task returns a spanning forest of the links it found, never all pairs of a group.

Exact links.  With ``least``, links of fingerprints are candidates only.  Bands of min-hashes of the same
shingles add the pairs that bits miss near the threshold; then all pairs within a group of candidates are
compared by their whole shingle sets, and those of at least that Jaccard similarity stay.

Defined cases: null and empty texts have fingerprint 0 and link like any other; texts shorter than
one shingle are hashed whole; repeated rows give repeated results; an empty table gives no rows;
other columns of the input are ignored; a null doc_id never becomes a component's id unless the
component has no other.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, by_key, components, dealt_as_grid, np_components, small_batches

WIDTH, SEED = 64, 42
#: Fingerprints under one top node above which it is dealt out in parts.
HOT_NODE = 4096
#: Fingerprints under one top node, about, where rows must go to several nodes.
WIDE_NODE = 1 << 16
#: Node pairs with at most so many leaf pairs are compared at once instead of going deeper.
LEAF_PAIRS = 256
CHUNK_PAIRS = 1 << 20
TASK_ROWS = 200_000
#: Min-hashes: a band of five is equal for 0.8 ** 5 of the pairs of similarity 0.8, one of 16 bands for 0.998 of them.
BANDS, BAND_ROWS = 16, 5
#: Texts of one group of candidates above which it is dealt out in parts; texts compared at once; shingles counted at once.
HOT_GROUP, SET_ROWS, SET_COLUMNS = 1024, 256, 8192


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle (bytes.lower and bytes.split know ASCII only, as the rule asks)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def remixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Other 64 bits for each hash, for the check words."""
    x = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of min-hashes; texts with an equal key are candidates."""
    if not len(hashes):
        return [0]
    least = np.array([remixed(hashes, 101 + n).min() for n in range(BANDS * BAND_ROWS)], np.uint64).reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least)]


def alike(sets: list[np.ndarray], others: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of a set and another whose Jaccard similarity is at least ``least``; two empty sets are alike."""
    def laid(x):
        return np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x) if x else np.empty(0, np.uint64)

    (r1, h1), (r2, h2) = laid(sets), laid(others)
    both = np.intersect1d(h1, h2)
    shared = np.zeros((len(sets), len(others)))
    for at in range(0, len(both), SET_COLUMNS):
        part = both[at : at + SET_COLUMNS]
        m = []
        for n, r, h in ((len(sets), r1, h1), (len(others), r2, h2)):
            c = np.minimum(np.searchsorted(part, h), len(part) - 1)
            ok = part[c] == h
            x = np.zeros((n, len(part)), np.float32)
            x[r[ok], c[ok]] = 1
            m.append(x)
        shared += m[0] @ m[1].T
    every = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :] - shared
    return np.nonzero(shared >= least * every - 1e-9)


def exact_forest(key, side, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) of the alike pairs of the tasks in these rows: sorted by (key, side)."""
    n = len(key)
    label = np.arange(n)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    for lo, hi in zip(new, [*new[1:], n]):
        mid = lo + int(np.count_nonzero(side[lo:hi] == 0))
        own = mid in (lo, hi)
        for a in range(lo, hi if own else mid, SET_ROWS):
            a2 = min(a + SET_ROWS, hi if own else mid)
            for b in range(a if own else mid, hi, SET_ROWS):
                i, j = alike(sets[a:a2], sets[b : min(b + SET_ROWS, hi)], least)
                label = np_components(n, i + a, j + b, label)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def whole_signatures(docs: DataFrame, k: int, checks: int) -> DataFrame:
    """(doc_id, text, row, node, bands, fp, c1..): as ``signatures``; ``node`` names the set of shingles."""
    names = ["fp", *(f"c{n + 1}" for n in range(checks))]

    def run(batches):
        for b in batches:
            out, node, bands = [[] for _ in names], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(text or b"", k)
                for n, to in enumerate(out):
                    to.append(majority(remixed(h, n) if n else h))
                h = np.unique(h)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                bands.append(np.array(band_keys(h), np.uint64).view(np.int64))
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, *out)]
            yield pa.RecordBatch.from_arrays([*b.columns, cols[0], pa.array(bands, pa.list_(pa.int64())), *cols[1:]], names=["doc_id", "text", "row", "node", "bands", *names])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, row long, node long, bands array<long>, " + ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema)


def band_links(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """Links (a, b) of each node to the least one that has an equal band key."""
    keys = ws.save(nodes.select("node", F.explode("bands").alias("key")), "bands")
    least = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("key", "b")
    return keys.join(ws.save(least, "least-of-band"), "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def exact_links(groups: DataFrame, k: int, least: float, ws: Workspace, hot: int | None = None) -> DataFrame:
    """Spanning links (a, b) of the pairs within ``groups(root, node, text)`` whose shingle sets are ``least`` alike."""
    spark = groups.sparkSession
    rows = groups.select(F.col("root").alias("top"), F.lit(True).alias("same"), F.lit(0).alias("side"), "node", "text")
    counts = rows.groupBy("top").agg(F.count("*").alias("n"))
    rows = dealt_as_grid(rows, hot or HOT_GROUP, ws, counts)
    rows = rows.select("key", "side", "node", "text").repartition("key").sortWithinPartitions("key", "side")

    def run(batches):
        for t in by_key(batches, 2 * HOT_GROUP):
            key, side, node = (t.column(n).to_numpy() for n in range(3))
            sets = [np.unique(shingle_hashes(x or b"", k)) for x in t.column(3).cast(pa.binary()).to_pylist()]
            i, j = exact_forest(key, side, sets, least)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    small_batches(spark)
    return ws.save(rows.mapInArrow(run, "a long, b long"), "exact-links")


def signatures(docs: DataFrame, k: int = 4, checks: int = 0) -> DataFrame:
    """(doc_id, fp, c1..): the fingerprint, and ``checks`` more of other hash bits."""
    names = ["fp", *(f"c{n + 1}" for n in range(checks))]

    def run(batches):
        for b in batches:
            out = [[] for _ in names]
            for text in b.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(text or b"", k)
                for n, to in enumerate(out):
                    to.append(majority(remixed(h, n) if n else h))
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *names])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def trie_pairs(rot, lo1, hi1, lo2, hi2, err, depth, lead, lead_budget, budget):
    """Walk node pairs of the trie over sorted ``rot``; yield arrays (lo1, hi1, lo2, hi2) to compare.

    A node is a range of positions; [lo1, hi1) == [lo2, hi2) is a node with itself.
    """
    while len(lo1):
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = (n1 * n2 <= LEAF_PAIRS) | (depth >= WIDTH)
        if small.any():
            yield lo1[small], hi1[small], lo2[small], hi2[small]
            go = ~small
            lo1, hi1, lo2, hi2, err = lo1[go], hi1[go], lo2[go], hi2[go], err[go]
            if not len(lo1):
                return
        ones = np.concatenate(([0], np.cumsum((rot >> np.uint64(WIDTH - 1 - depth)) & np.uint64(1)))).astype(np.int64)
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        own = (lo1 == lo2) & (hi1 == hi2)
        nxt = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1)]
        cross = ~own
        nxt.append((mid1[cross], hi1[cross], lo2[cross], mid2[cross], err[cross] + 1))
        lo1, hi1, lo2, hi2, err = (np.concatenate(x) for x in zip(*nxt))
        keep = (hi1 > lo1) & (hi2 > lo2) & (err <= (lead_budget if depth < lead else budget))
        keep &= ~((lo1 == lo2) & (hi1 == hi2) & (hi1 - lo1 == 1))
        lo1, hi1, lo2, hi2, err = lo1[keep], hi1[keep], lo2[keep], hi2[keep], err[keep]
        depth += 1


def halves(lo1, hi1, lo2, hi2):
    """Cut large node pairs until each has at most CHUNK_PAIRS leaf pairs."""
    while len(lo1):
        own = (lo1 == lo2) & (hi1 == hi2)
        big = (hi1 - lo1) * (hi2 - lo2) > CHUNK_PAIRS
        yield lo1[~big], hi1[~big], lo2[~big], hi2[~big]
        lo1, hi1, lo2, hi2, own = lo1[big], hi1[big], lo2[big], hi2[big], own[big]
        m1, m2 = (lo1 + hi1) // 2, (lo2 + hi2) // 2
        nxt = [(lo1, m1, lo2, m2), (m1, hi1, m2, hi2), (lo1, m1, m2, hi2), (m1[~own], hi1[~own], lo2[~own], m2[~own])]
        lo1, hi1, lo2, hi2 = (np.concatenate(x) for x in zip(*nxt))
        full = (hi1 > lo1) & (hi2 > lo2)
        lo1, hi1, lo2, hi2 = lo1[full], hi1[full], lo2[full], hi2[full]


def forest(key, side, rot, checks, top, lead, lead_budget, budget, check_bits) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) of the tasks in these rows: sorted by (key, side, rot)."""
    n = len(key)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lo, hi = new, np.concatenate((new[1:], [n]))
    sides = np.concatenate(([0], np.cumsum(side))).astype(np.int64)
    mid = hi - (sides[hi] - sides[lo])
    own = mid == hi
    lo1, hi1 = lo, mid
    lo2, hi2 = np.where(own, lo, mid), hi
    full = (hi1 > lo1) & (hi2 > lo2)
    lo1, hi1, lo2, hi2 = lo1[full], hi1[full], lo2[full], hi2[full]
    err = np.bitwise_count((rot[lo1] ^ rot[lo2]) >> np.uint64(WIDTH - top)).astype(np.int64)
    label = np.arange(n)
    for found in trie_pairs(rot, lo1, hi1, lo2, hi2, err, top, lead, lead_budget, budget):
        for a1, b1, a2, b2 in halves(*found):
            size = (b1 - a1) * (b2 - a2)
            cuts = np.searchsorted(np.cumsum(size), np.arange(CHUNK_PAIRS, size.sum() + CHUNK_PAIRS, CHUNK_PAIRS)) + 1 if len(size) else []
            at = 0
            for cut in [*np.unique(np.minimum(cuts, len(size)))] if len(size) else []:
                s = slice(at, cut)
                at = cut
                which = np.repeat(np.arange(s.start, s.stop), size[s])
                within = np.arange(len(which)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
                w2 = (b2 - a2)[which]
                i, j = a1[which] + within // w2, a2[which] + within % w2
                ok = (i != j) & (np.bitwise_count(rot[i] ^ rot[j]) <= budget)
                i, j = i[ok], j[ok]
                if checks and len(i):
                    d = np.bitwise_count(rot[i] ^ rot[j]).astype(np.int64)
                    for c in checks:
                        d += np.bitwise_count(c[i] ^ c[j])
                    i, j = i[d <= check_bits], j[d <= check_bits]
                if len(i):
                    label = np_components(n, i, j, label)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def deeper(rows: DataFrame, top: int, radius: int, blocks: int, hot: int, ws: Workspace) -> DataFrame:
    """Rows of nodes with over ``hot`` fingerprints once for each block of the bits under the node, that block moved up.

    Each such row goes to ``blocks`` nodes of some thousandth of the size, whatever the size, so that rows grow in
    proportion to the fingerprints.
    """
    many = ws.save(rows.groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("top", F.lit(True).alias("many")), "wide-nodes")
    if many.isEmpty():
        return rows
    left = WIDTH - top
    starts = [left * u // blocks for u in range(blocks)]
    lead = min(b - a for a, b in zip(starts, [*starts[1:], left]))
    low = (1 << left) - 1
    rows = rows.join(many, "top", "left")
    below = rows.where("many").withColumn("u", F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(s).alias("s")) for u, s in enumerate(starts)])))
    under = F.col("rot").bitwiseAND(F.lit(low))
    moved = F.expr("shiftleft(_under, u.s)").bitwiseOR(F.expr(f"shiftrightunsigned(_under, {left} - u.s)")).bitwiseAND(F.lit(low))
    rot = F.col("rot").bitwiseAND(F.lit(~low)).bitwiseOR(moved)
    below = below.withColumn("_under", under).withColumn("rot", rot)
    block = F.shiftrightunsigned("rot", WIDTH - top - lead).bitwiseAND(F.lit((1 << lead) - 1))
    # the trie and node above (in bits 56 to 61 and 0 to 27), the block, and its bits in 28 to 49
    node = F.col("top").bitwiseAND(F.lit((0x3F << 56) | (1 << 28) - 1)).bitwiseOR(F.lit(1 << 62))
    node = node.bitwiseOR(F.shiftleft(F.col("u.u").cast("long"), 50)).bitwiseOR(F.shiftleft(block, 28))
    below = below.withColumn("top", node).withColumn("depth", F.lit(top + lead))
    names = [c for c in rows.columns if c != "many"]
    return rows.where("many is null").select(*names).unionByName(below.select(*names))


def links(nodes: DataFrame, ws: Workspace, radius: int = 4, blocks: int = 5, checks: int = 0, check_bits: int = 0,
          searched: int = 1, hot: int | None = None) -> DataFrame:
    """Spanning links (a, b) between ``nodes(node, fp, c1..)``: some of the first ``searched`` fingerprints within
    ``radius`` bits, and with ``checks`` all fingerprints together within ``check_bits``."""
    spark = nodes.sparkSession
    starts = [WIDTH * t // blocks for t in range(blocks)]
    lead, lead_budget = min(b - a for a, b in zip(starts, [*starts[1:], WIDTH])), radius // blocks
    # without errors in the leading block its whole width names the task; else few bits, as a row goes to each node in reach
    top = lead if not lead_budget else min(lead, max(2, (nodes.count() // WIDE_NODE).bit_length()))
    hot = hot or (HOT_NODE if not lead_budget else 4 * WIDE_NODE)
    masks = [sum(1 << x for x in c) for e in range(lead_budget + 1) for c in combinations(range(top), e)]
    words, names = ["fp", *(f"c{n + 1}" for n in range(checks))], [f"o{n + 1}" for n in range(checks)]

    def turned(word, s):
        return F.col(word) if not s else F.shiftleft(word, s).bitwiseOR(F.shiftrightunsigned(word, WIDTH - s))

    tries = []
    for k, word in enumerate(words[:searched]):
        others = [F.col(w).alias(n) for w, n in zip([w for w in words if w != word], names)]
        tries += [F.struct(F.lit(k * blocks + t).alias("t"), turned(word, s).alias("rot"), *others) for t, s in enumerate(starts)]
    rows = nodes.select("node", F.explode(F.array(*tries)).alias("x")).select("node", "x.*")
    rows = rows.withColumn("own", F.shiftrightunsigned("rot", WIDTH - top))
    if len(masks) > 1:
        rows = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        rows = rows.withColumn("other", F.col("own").bitwiseXOR(F.col("mask"))).drop("mask")
    else:
        rows = rows.withColumn("other", F.col("own"))
    rows = rows.withColumn("side", (F.col("own") > F.col("other")).cast("int")).withColumn(
        "top", F.shiftleft(F.col("t").cast("long"), 56).bitwiseOR(F.shiftleft(F.least("own", "other"), 28)).bitwiseOR(F.greatest("own", "other")))
    rows = rows.withColumn("same", F.col("own") == F.col("other")).drop("own", "other", "t").withColumn("depth", F.lit(top))
    if not lead_budget:
        rows = deeper(rows, top, radius, blocks, hot, ws)
    rows = dealt_as_grid(rows, hot, ws)
    rows = rows.select("key", "side", "depth", "rot", "node", *names).repartition("key").sortWithinPartitions("key", "side")

    def run(batches):
        for t in by_key(batches, TASK_ROWS):
            every, depth = [t.column(n).to_numpy() for n in (0, 1, 3, 4, *range(5, 5 + checks))], t.column(2).to_numpy()
            for begin in np.unique(depth):
                key, side, rot, node, *cs = (x[depth == begin] for x in every)
                rot, cs = rot.view(np.uint64), [c.view(np.uint64) for c in cs]
                order = np.lexsort((rot, side, key))
                key, side, rot, node, cs = key[order], side[order], rot[order], node[order], [c[order] for c in cs]
                i, j = forest(key, side, rot, cs, int(begin), lead, lead_budget, radius, check_bits)
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    small_batches(spark, 10_000)
    out = ws.save(rows.mapInArrow(run, "a long, b long"), "links")
    small_batches(spark)
    return out


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, blocks: int = 5, checks: int = 0,
                    check_bits: int = 0, searched: int = 1, hot: int | None = None, least: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs(doc_id, text)``.

    With ``checks`` more fingerprints of other hash bits, a link must also differ in at most
    ``check_bits`` of all bits together, which keeps unlike texts apart at a wide ``radius``; the
    first ``searched`` of them are searched, each in tries of its own.

    With ``least``, a link must have that Jaccard similarity of the sets of shingles.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    small_batches(spark)
    names = ["fp", *(f"c{n + 1}" for n in range(checks))]
    if least is None:
        sigs = ws.save(signatures(docs, k, checks), "signatures")
        node = F.xxhash64(*names) if checks else F.col("fp")
        nodes = ws.save(sigs.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("node", node), "nodes")
        found = components(spark, links(nodes, ws, radius, blocks, checks, check_bits, searched, hot), ws)
    else:
        sigs, node = ws.save(whole_signatures(docs, k, checks), "signatures"), F.col("node")
        one = sigs.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.min_by(F.struct("bands", *names), "row").alias("x"))
        nodes = ws.save(one.select("node", "first", "row", "x.*"), "nodes")
        near = links(nodes.select("node", *names), ws, radius, blocks, checks, check_bits, searched, hot)
        near = near.unionByName(band_links(nodes, ws))
        groups = ws.save(components(spark, near, ws).join(nodes.select("node", "row"), "node"), "groups")
        texts = ws.save(groups.join(sigs.select("row", "text"), "row").select("root", "node", "text"), "candidates")
        found = components(spark, exact_links(texts, k, least, ws, hot), ws)
    member = ws.save(found.join(nodes.select("node", "first"), "node"), "members")
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = ws.save(member.join(ws.save(lowest, "least"), "root").select("node", "component_id"), "ids")
    of = ws.save(nodes.join(ids, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")), "classes")
    return sigs.withColumn("node", node).join(of, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
