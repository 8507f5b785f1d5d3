"""Substring dedup by seed and extend: winnowed anchors, then matches extended word by word around repeated ones.

Every window of ``window`` words has one anchor: its leftmost least ``k``-word hash.  Equal windows
have equal anchors at equal places, so a window can repeat only where its anchor does.

1. Seeds: anchors that two different texts hold, or one text twice, are gathered (partial sums
   before the shuffle).  Whole copies of a text are told by 128 bits of hash of the text instead.
2. Extend: the places of one anchor are joined.  From the anchor the match goes on to the left and to
   the right, one word at a time; places that agree so far share a class.  A window is known by its left
   and right class, and is marked if it also starts earlier (smaller doc_id, or earlier in the same
   document).  Words are compared, not hashes.  Each task first settles what repeats inside its own batch,
   so a passage that many documents share reaches the shuffle once per batch, not once per document.
   The windows of an anchor with more than ``HOT_ANCHOR`` places are dealt out one by one by their words
   instead, with partial minima, so no task holds all places of a frequent phrase.
3. The marked windows of a document, joined, are its maximal repeated spans; their words go.

A map of which anchors repeat goes to the executors as a Bloom filter of at most ``BLOOM_BITS``
bits; if there are more anchors than it can tell apart, a shuffled semi-join does that work.

Defined cases: null texts are empty; texts of under ``window`` words lose nothing; a row whose
doc_id is null is later than all others, and nothing in it is removed; rows repeated with one
doc_id and text count as one document; rows of one doc_id with different texts are documents of their
own, in the order of a hash of the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, bloom, by_key, empty_text, in_bloom, small_batches

WINDOW, K = 20, 10
BLOOM_BITS = 1 << 28
#: Bytes of text that are hashed together (a longer text is one piece).
PIECE = 1 << 20
TASK_ROWS = 50_000
#: Places of one anchor above which its windows are dealt out by their words.
HOT_ANCHOR = 4096
_MASK = (1 << 64) - 1
_R, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b & _MASK, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(out)
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[lo:hi] for each range."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[hi] - total[lo]) * down[lo])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and where each text's words begin (one more at the end)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    lo = np.flatnonzero(~space & before)
    hi = np.flatnonzero(space & ~before)
    h = runs(_BYTES[raw], lo, hi, _R) + (hi - lo).astype(np.uint64)
    return h, np.concatenate(([0], np.searchsorted(lo, ends)))


def windows(h: np.ndarray, begin: np.ndarray, window: int, k: int):
    """(document, start, window hash, anchor position, anchor hash) of every whole window."""
    n = len(h) - window + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return z, z, z.astype(np.uint64), z, z.astype(np.uint64)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[:n]
    start = np.flatnonzero(np.arange(n) + window <= begin[1:][doc])
    doc = doc[start]
    at = np.arange(len(h) - k + 1)
    gram = runs(h, at, at + k, _Q)
    best, where = gram[start], start.copy()
    for s in range(1, window - k + 1):
        other = gram[start + s]
        less = other < best
        best = np.where(less, other, best)
        where[less] = start[less] + s
    return doc, start, runs(h, start, start + window, _Q), where, best


def text_key():
    """What tells apart the texts of one doc_id."""
    return F.xxhash64(empty_text())


def pieces(texts: list[bytes]):
    """Ranges of texts that are hashed together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def seeds(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(h, text, n) of each anchor of each document; n: at how many places of the text it stands."""

    def run(batches):
        for b in batches:
            texts, kind = b.column(0).to_pylist(), b.column(1).to_numpy()
            for lo, hi in pieces(texts):
                doc, _, _, where, anchor = windows(*word_hashes(texts[lo:hi]), window, k)
                if not len(doc):
                    continue
                new = np.concatenate(([True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])))
                doc, anchor = doc[new], anchor[new]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))))
                n = np.diff(np.concatenate((first, [len(doc)])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[first].view(np.int64)), pa.array(kind[lo:hi][doc[first]]), pa.array(n.astype(np.int32))],
                    names=["h", "text", "n"])

    rows = docs.select(F.encode(empty_text(), "UTF-8").alias("t"), text_key().alias("k"))
    return rows.mapInArrow(run, "h long, text long, n int")


_RUNS = "h long, doc_id long, text long, start int, n int, at int, words binary"


def same_words(codes: np.ndarray, one: np.ndarray, two: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows that start at ``one`` and at ``two`` have the same words."""
    out = np.ones(len(one), bool)
    for i in range(window):
        out &= codes[one + i] == codes[two + i]
    return out


def candidates(docs: DataFrame, window: int, k: int, known) -> DataFrame:
    """Runs of windows around one place of an anchor (h, doc_id, text, start, n, at, words): ``words`` are those of the run,
    the anchor is ``at`` words from its start; runs that are marked already have null words."""

    def run(batches):
        for b in batches:
            ids, kind, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            order = np.lexsort((kind, ids))
            ids, kind, texts = ids[order], kind[order], [texts[i] for i in order]
            for lo, hi in pieces(texts):
                h, begin = word_hashes(texts[lo:hi])
                doc, start, hash_, where, anchor = windows(h, begin, window, k)
                if known is not None:
                    keep = in_bloom(anchor, *known.value)
                    doc, start, hash_, where, anchor = (x[keep] for x in (doc, start, hash_, where, anchor))
                if not len(doc):
                    continue
                words = b" ".join(texts[lo:hi]).split()
                code: dict = {}
                codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
                # texts are in the order of documents: of equal windows the first here is the earliest
                _, first, inverse = np.unique(hash_, return_index=True, return_inverse=True)
                first = first[inverse]
                own, mine = ids[lo:hi], kind[lo:hi]
                twin = (own[doc] == own[doc[first]]) & (mine[doc] == mine[doc[first]])
                place = start - begin[doc]
                marked = (first != np.arange(len(hash_))) & (~twin | (place[first] < place))
                at = np.flatnonzero(marked)
                marked[at] = same_words(codes, start[at], start[first[at]], window)
                cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (where[1:] != where[:-1]) | (marked[1:] != marked[:-1])))
                at = np.flatnonzero(cut)
                n = np.diff(np.concatenate((at, [len(doc)])))
                around = [None if m else b" ".join(words[s : s + c + window - 1]) for m, s, c in zip(marked[at].tolist(), start[at].tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(marked[at], mixed(start[at].astype(np.uint64)), anchor[at]).view(np.int64)), pa.array(own[doc[at]]), pa.array(mine[doc[at]]),
                     pa.array(place[at].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((where - start)[at].astype(np.int32)), pa.array(around, pa.binary())],
                    names=["h", "doc_id", "text", "start", "n", "at", "words"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_key().alias("k"), F.encode(empty_text(), "UTF-8").alias("t"))
    return rows.mapInArrow(run, _RUNS)


def extended(places, window: int, k: int):
    """(document, start, n) of the windows that also start earlier, for the places (document, start, n, at, words) of one
    anchor in the order of documents and starts."""
    left: dict = {}
    right: dict = {}
    first: dict = {}
    for doc, start, n, at, words in places:
        w = words.split(b" ")
        begin = tuple(w[at : at + k])
        side = left.setdefault(begin, len(left))
        lefts = [side]
        for x in reversed(w[:at]):
            side = left.setdefault((side, x), len(left))
            lefts.append(side)
        side = right.setdefault(begin, len(right))
        rights = [side]
        for x in w[at + k :]:
            side = right.setdefault((side, x), len(right))
            rights.append(side)
        open_ = None
        for i in range(n):
            here = doc, start + i
            key = lefts[at - i], rights[window - k - at + i]
            if first.setdefault(key, here) != here:
                open_ = i if open_ is None else open_
            elif open_ is not None:
                yield doc, start + open_, i - open_
                open_ = None
        if open_ is not None:
            yield doc, start + open_, n - open_


def settle(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, text, start, n): runs of windows that also start earlier; of anchors that one task can hold."""

    def run(batches):
        for t in by_key(batches, TASK_ROWS):
            key, has = t.column(0).to_numpy(), t.column(6).is_valid().to_numpy()
            doc, kind, start, n, at = (t.column(i).to_numpy() for i in range(1, 6))
            done = ~has
            if done.any():
                yield batch(doc[done], kind[done], start[done], n[done])
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            several = np.flatnonzero(np.diff(np.concatenate((new, [len(key)]))) > 1)
            words, out = t.column(6), []
            for g in several.tolist():
                lo, hi = new[g], new[g + 1] if g + 1 < len(new) else len(key)
                rows = zip(zip(doc[lo:hi].tolist(), kind[lo:hi].tolist()), start[lo:hi].tolist(), n[lo:hi].tolist(), at[lo:hi].tolist(), words[lo:hi].to_pylist())
                out += extended([r for r in rows if r[4] is not None], window, k)
            if out:
                yield batch([d[0] for d, _, _ in out], [d[1] for d, _, _ in out], [s for _, s, _ in out], [c for _, _, c in out])

    def batch(doc, kind, start, n):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kind, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "text", "start", "n"])

    return rows.repartition("h").sortWithinPartitions("h", "doc_id", "text", "start").mapInArrow(run, "doc_id long, text long, start int, n int")


def settle_hot(rows: DataFrame, window: int, ws: Workspace) -> DataFrame:
    """As ``settle``, for anchors with very many places: each window by its words; the earliest is a partial minimum."""
    word = F.split(F.col("words").cast("string"), " ")
    each = rows.select("doc_id", "text", "start", word.alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    each = each.select(F.struct("doc_id", "text", (F.col("start") + F.col("i")).alias("start")).alias("here"), F.array_join(F.slice("w", F.col("i") + 1, window), " ").alias("w"))
    each = ws.save(each, "hot-windows")
    least = ws.save(each.groupBy("w").agg(F.min("here").alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first"), "hot-first")
    return each.join(least, "w").where("here <> first").select("here.doc_id", "here.text", "here.start", F.lit(1).alias("n"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = K, ws: Workspace | None = None, hot: int | None = None) -> DataFrame:
    """(doc_id, text, starts, counts, copy): the marked runs of windows of each document that has any.

    ``text`` is the ``text_key`` of the document.  ``copy`` marks a document whose whole text an earlier one has:
    all its windows are marked.
    """
    spark = docs.sparkSession
    ws, hot = ws or Workspace(spark, "substring"), HOT_ANCHOR if hot is None else hot
    small_batches(spark)
    found = seeds(docs, window, k).groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.max("n").alias("c"), F.sum("n").alias("n"))
    again = ws.save(found.where("a <> b or c > 1").select("h", "n"), "anchors")
    n, most = again.agg(F.count("*"), F.max("n")).first()
    known = bloom(again.select("h"), n, BLOOM_BITS)
    sent = spark.sparkContext.broadcast(known) if known is not None else None
    rows = candidates(docs, window, k, sent)
    if sent is None:
        rows = ws.save(rows, "runs")
        rows = rows.where("words is null").unionAll(rows.where("words is not null").join(again, "h", "left_semi"))
    # the windows around one place give at most so many runs, with marked ones between them
    pieces_of_place = (window - k + 2) // 2
    if (most or 0) * pieces_of_place > hot:
        rows = ws.save(rows, "runs")
        open_ = rows.where("words is not null").join(again.where(F.col("n") * pieces_of_place > hot), "h", "left_semi")
        many = ws.save(open_.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "hot-anchors")
        cold = rows.where("words is null").unionAll(rows.where("words is not null").join(many, "h", "left_anti"))
        spans = settle(cold, window, k).unionAll(settle_hot(rows.where("words is not null").join(many, "h", "left_semi"), window, ws))
    else:
        spans = settle(rows, window, k)
    spans = ws.save(spans.groupBy("doc_id", "text").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts")), "spans")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text"), F.xxhash64(F.lit(1), empty_text()).alias("text2"))
    least = ids.groupBy("text", "text2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    copies = ws.save(ids.join(ws.save(least, "texts"), ["text", "text2"]).where("doc_id > least").select("doc_id", "text").distinct(), "copies")
    out = spans.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "text"], "full").withColumn("copy", F.coalesce("copy", F.lit(False)))
    return ws.save(out, "marked")


def deduplicated(docs: DataFrame, window: int = WINDOW, k: int = K, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, *keep) of each row of ``docs(doc_id, text)``.

    ``kept_text`` has the words left, joined by one space; it is null where nothing was removed,
    and the caller has the text itself.
    """
    marked = repeated_windows(docs, window, k)
    keep = keep or []
    rows = docs.select("doc_id", empty_text().alias("text"), text_key().alias("own_key"), *[F.col(c).alias(f"_{c}") for c in keep])
    # a text is one cell here; the marks of a document are bounded by its own words
    marked = marked.withColumnsRenamed({"doc_id": "marked_id", "text": "marked_key"})
    rows = rows.join(marked, (F.col("doc_id").cast("long") == F.col("marked_id")) & (F.col("own_key") == F.col("marked_key")), "left").drop("marked_id", "marked_key", "own_key")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items() if n not in ("starts", "counts", "copy"))

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, counts, copy in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("text", "starts", "counts", "copy"))):
                words = text.encode().split()
                n, out = len(words), None
                if n >= window and (copy or starts):
                    gone = np.zeros(n + 1, np.int64)
                    if copy:
                        gone[0] += 1
                    else:
                        s, c = np.array(starts), np.array(counts)
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + c - 1 + window, -1)
                    left = np.flatnonzero(np.cumsum(gone[:n]) == 0).tolist()
                    if len(left) < n:
                        out = b" ".join([words[i] for i in left]).decode()
                        n_removed.append(n - len(left))
                if out is None:
                    n_removed.append(0)
                n_words.append(n)
                kept.append(out)
            cols = [b.column(i) for i, c in enumerate(b.schema.names) if c not in ("starts", "counts", "copy")]
            names = [c for c in b.schema.names if c not in ("starts", "counts", "copy")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    out = rows.mapInArrow(run, schema + ", n_words long, n_removed long, kept_text string")
    return out.select("doc_id", "text", "n_words", "n_removed", "kept_text", *[F.col(f"_{c}").alias(c) for c in keep])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    out = deduplicated(docs)

    def run(batches):
        for b in batches:
            kept = b.column(2).to_pylist()
            sha = [hashlib.sha256(k.encode() if k is not None else b" ".join(t.encode().split())).hexdigest() for t, k in zip(b.column(1).to_pylist(), kept)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = dict(out.dtypes)["doc_id"]
    return out.select("doc_id", "text", "kept_text", "n_words", "n_removed").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
