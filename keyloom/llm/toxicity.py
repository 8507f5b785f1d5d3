"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, of toxic and of ordinary text, give each letter of a word a probability after up to
``ORDER - 1`` letters before it (``^`` begins a word, ``$`` ends it).  Each discounts its own counts and gives what
it saves to one shared backoff: recursive Kneser-Ney, whose continuation counts at every lower order come
from both classes together, so expressions that are rare in either class weigh little.  A word's score is the
difference of its two log-likelihoods.  A text's features are length-normalised differences: over all its words (by their
number and by its square root), over the ``SPANS`` words in a row where it is largest, and the shares of words that lean
to the toxic model by more than ``STRONG``.  A logistic regression makes a probability of them.

Counts come from all labelled rows outside the held-out remainder.  The regression is fitted on at most
``FIT_ROWS`` of the labelled rows of one remainder, scored by models of the others.  The models are one
table of the 64-bit hashes of all n-grams and contexts, none left out, sorted, in the shared folder; it grows with the
different n-grams of the labelled rows.  Up to ``SENT_GRAMS`` entries it is sent along; beyond that each task reads it block by
block for a stretch of texts at a time, with the same results.

Defined cases: null and empty texts score as texts without words; without labelled rows of both classes
every score is 0; several labels of one doc_id: toxic if any is; null labels are ignored; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, empty_text, small_batches
from keyloom.llm.files import store

ORDER, DISCOUNT = 6, 0.75
PAD = ORDER - 1
FIT_ROWS = 20_000
HELD_OUT, FIT_ON = 2, 1
THRESHOLD = 0.3
#: Up to so many labels travel with the scan of the texts; more are joined by shuffle.
SENT_LABELS = 2_000_000
#: Up to so many n-grams and contexts, of 16 bytes each, travel as a broadcast.
SENT_GRAMS = 4_000_000
#: Lengths of the stretches of words that are looked at apart from the whole text.
SPANS = (1, 2, 4, 8, 16, 32)
STRONG = (1.0, 2.0, 3.0, 4.5)
LEAST, MOST = -2.0, 8.0
#: Letters that are hashed at once; different n-grams that a task counts before it passes them on.
PIECE, COUNTED = 1 << 20, 600_000
#: Characters of texts that are looked up together where the model is read from the shared folder.
STRETCH = 1 << 24
_words = re.compile(r"\w+").findall
BEGIN, END = ord("^"), ord("$")
_MIX, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def remainder():
    """Of the document: crc32 of doc_id as text, modulo 4."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)).cast("int")


def with_labels(docs: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """(text, toxic, rest) of the labelled rows that may be learnt from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = ws.save(known.withColumn("rest", remainder()).where(F.col("rest") != HELD_OUT), "labels")
    side = F.broadcast(known) if known.count() <= SENT_LABELS else known
    return docs.select("doc_id", empty_text().alias("text")).join(side, "doc_id").select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"), "rest")


def stream(text: str) -> str:
    """The words of a text with their marks, after PAD blanks; "" without words."""
    words = _words(text.lower())
    return " " * PAD + "^" + "$^".join(words) + "$" if words else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, context, length of the context) of each letter after the first PAD; contexts begin with their word."""
    n, at = max(0, len(letters) - PAD), np.arange(len(letters))
    before = np.minimum(at - np.maximum.accumulate(np.where(letters == BEGIN, at, -PAD)), PAD)[PAD:]
    h = np.full(n, ORDER, np.uint64)
    for k in range(ORDER):
        if k == PAD:
            context = h ^ _CONTEXT
        h = (h ^ np.where(before >= PAD - k, letters[k : k + n], 0).astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h, context, before


def parts(streams: list[str]):
    """(stream, from, to) of groups of about PIECE letters; a long stream is in several."""
    group, size = [], 0
    for i, s in enumerate(streams):
        for a in range(PAD, len(s), PIECE):
            b = min(a + PIECE, len(s))
            group.append((i, a, b))
            size += b - a
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, h, hc, t, o, ft, fo): each n-gram with its hash and its context's, and its counts in toxic and ordinary rows;
    f: without the rows kept to fit on."""

    def merged(held, new):
        if held is None:
            return new
        grams, h, hc, n = (np.concatenate(x) for x in zip(held, new))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.zeros((len(first), 4), np.int64)
        np.add.at(total, inverse, n)
        return grams[first], h[first], hc[first], total

    def batch(held):
        grams, h, hc, n = held
        cols = [pa.array(grams.tolist(), pa.string()), pa.array(h.view(np.int64)), pa.array(hc.view(np.int64))]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(x) for x in (n[:, 0] + n[:, 2], n[:, 1] + n[:, 3], n[:, 0], n[:, 1]))], names=["gram", "h", "hc", "t", "o", "ft", "fo"])

    def run(batches):
        held = None
        for b in batches:
            streams = [stream(t) for t in b.column(0).to_pylist()]
            kind = [2 * (rest == FIT_ON) + (not toxic) for toxic, rest in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            for group in parts(streams):
                text = "".join([streams[i][a - PAD : e] for i, a, e in group])
                size = np.array([e - a for _, a, e in group])
                letters = codes(text)
                h, hc, before = hashes(letters)
                # what stands at the joints is no letter of any text
                begin = np.cumsum(size + PAD) - size - PAD
                at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                own = np.repeat([kind[i] for i, _, _ in group], size)
                counted = letters[PAD:][at] != BEGIN
                at, own = at[counted], own[counted]
                h, hc, before = h[at], hc[at], before[at]
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(inverse * 4 + own, minlength=4 * len(first)).reshape(-1, 4)
                grams = np.array([text[x + PAD - c : x + ORDER] for x, c in zip(at[first].tolist(), before[first].tolist())], object)
                held = merged(held, (grams, h[first], hc[first], n))
                if len(held[1]) > COUNTED:
                    yield batch(held)
                    held = None
        if held is not None:
            yield batch(held)

    counts = [F.sum(c).alias(c) for c in ("t", "o", "ft", "fo")]
    out = rows.select("text", "toxic", "rest").mapInArrow(run, "gram string, h long, hc long, t long, o long, ft long, fo long")
    return out.groupBy("gram", "h", "hc").agg(*counts)


def shared_backoff(grams: DataFrame, ws: Workspace) -> DataFrame:
    """(g, p): the probability of the last of the letters ``g`` (up to ``ORDER - 1``) after those before it.

    Kneser-Ney at each order: a count is the number of different letters (or ``^``) before, in either class.
    """
    out = below = None
    for k in range(1, ORDER):
        longer = grams.where(F.length("gram") > k).select(F.expr(f"right(gram, {k + 1})").alias("y")).distinct()
        own = longer.groupBy(F.expr(f"right(y, {k})").alias("g")).agg(F.count("*").alias("n"))
        if k == 1:
            own = ws.save(own, "letters")
            kinds, total = own.agg(F.count("*"), F.sum("n")).first()  # one row for each letter
            total = total or 1
            below = own.select("g", ((F.col("n") - DISCOUNT) / total + DISCOUNT / total).alias("p"))
        else:
            own = ws.save(own.withColumn("ctx", F.expr(f"left(g, {k - 1})")).withColumn("tail", F.expr(f"right(g, {k - 1})")), f"order-{k}")
            every = own.groupBy("ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
            rows = own.join(every, "ctx").join(below.select(F.col("g").alias("tail"), F.col("p").alias("q")), "tail")
            below = rows.select("g", ((F.col("n") - DISCOUNT) / F.col("all") + DISCOUNT * F.col("kinds") / F.col("all") * F.col("q")).alias("p"))
        below = ws.save(below, f"backoff-{k}")
        out = below if out is None else out.unionByName(below)
    return out


def ratios(grams: DataFrame, ws: Workspace) -> DataFrame:
    """(h, full, fit): the log ratio of each n-gram and (for letters not seen after it) of each context."""
    kinds = ("t", "o", "ft", "fo")
    grams = grams.withColumn("ctx", F.expr("left(gram, length(gram) - 1)")).withColumn("g", F.expr("right(gram, length(gram) - 1)"))
    contexts = grams.groupBy("ctx", "hc").agg(*[F.sum(x).alias(f"n_{x}") for x in kinds], *[F.count_if(F.col(x) > 0).alias(f"k_{x}") for x in kinds])

    def saved(x):
        return F.when(F.col(f"n_{x}") > 0, DISCOUNT * F.col(f"k_{x}") / F.col(f"n_{x}")).otherwise(1.0)

    def own(x):
        """The probability by one class's counts; where it has not seen the context, the shared one."""
        seen = F.when(F.col(f"n_{x}") > 0, F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) / F.col(f"n_{x}")).otherwise(0.0)
        return seen + saved(x) * F.col("p")

    shared = shared_backoff(grams, ws)
    rows = grams.join(contexts.drop("hc"), "ctx").join(shared, "g")
    seen = rows.select("h", F.log(own("t") / own("o")).cast("float").alias("full"), F.log(own("ft") / own("fo")).cast("float").alias("fit"))
    other = contexts.select(F.col("hc").alias("h"), F.log(saved("t") / saved("o")).cast("float").alias("full"), F.log(saved("ft") / saved("fo")).cast("float").alias("fit"))
    return seen.unionAll(other)


class Sent:
    """The model in memory: sorted hashes and their log ratios."""

    stretch = 0

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.start = np.append(self.start, len(keys))

    def ratio(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each hash."""
        place = (h >> self.shift).astype(np.int64)
        at, end = self.start[place], self.start[place + 1]
        found, value = np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            key = self.keys[at[todo]]
            hit = todo[key == h[todo]]
            found[hit], value[hit] = True, self.values[at[hit]]
            todo = todo[key < h[todo]]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return found, value

    def ready(self, streams: list[str]) -> Sent:
        return self


class Stored:
    """The model in the shared folder; ``ready`` reads the entries that a stretch of texts needs, block by block."""

    stretch = STRETCH

    def __init__(self, uri: str, column: str):
        self.uri, self.column = uri, column

    def ready(self, streams: list[str]) -> Sent:
        asked = [np.unique(np.concatenate(hashes(codes("".join([streams[i][a - PAD : e] for i, a, e in group])))[:2])) for group in parts(streams)]
        asked = np.unique(np.concatenate(asked)) if asked else np.empty(0, np.uint64)
        files, root = store(self.uri)
        keys, values = [], []
        for info in files.get_file_info(fs.FileSelector(root)):
            if not info.path.endswith(".parquet"):
                continue
            with files.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(1 << 20, columns=["h", self.column]):
                    h = b.column(0).to_numpy().view(np.uint64)
                    at = np.minimum(np.searchsorted(asked, h), max(0, len(asked) - 1))
                    hit = asked[at] == h if len(asked) else np.zeros(len(h), bool)
                    keys.append(h[hit])
                    values.append(b.column(1).to_numpy()[hit])
        keys, values = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((keys, np.uint64), (values, np.float32)))
        order = np.argsort(keys)
        return Sent(keys[order], values[order])


def word_scores(streams: list[str], model: Sent) -> list[np.ndarray]:
    """The log ratio of each word of each stream."""
    size = np.array([max(0, len(s) - PAD) for s in streams], np.int64)
    begin = np.cumsum(size) - size
    letters, last = np.zeros(size.sum(), np.float32), np.zeros(size.sum(), bool)
    for group in parts(streams):
        text = codes("".join([streams[i][a - PAD : e] for i, a, e in group]))
        h, hc, _ = hashes(text)
        found, value = model.ratio(h)
        other = np.flatnonzero(~found)
        value[other] = model.ratio(hc[other])[1]
        value[text[PAD:] == BEGIN] = 0
        at = 0
        for i, a, e in group:
            to = begin[i] + a - PAD
            letters[to : to + e - a] = value[at : at + e - a]
            last[to : to + e - a] = text[at + PAD : at + PAD + e - a] == END
            at += e - a + PAD
    out = []
    for i, n in zip(begin.tolist(), size.tolist()):
        ends = np.flatnonzero(last[i : i + n])
        total = np.concatenate(([0.0], np.cumsum(letters[i : i + n], dtype=np.float64)[ends]))
        out.append(np.diff(total))
    return out


N_FEATURES = 2 + len(SPANS) + 2 * len(STRONG)


def features(x: np.ndarray) -> list[float]:
    """Of a text, from the log ratios of its words."""
    n = len(x)
    if not n:
        return [0.0] * N_FEATURES
    total = np.concatenate(([0.0], np.cumsum(np.clip(x, LEAST, MOST))))
    out = [float(x.sum()) / n, float(total[-1]) / n**0.5]
    out += [float((total[m:] - total[:-m]).max()) / m for m in (min(s, n) for s in SPANS)]
    for s in STRONG:
        k = int((x > s).sum())
        out += [k / n, k / (n + 20.0) ** 0.5]
    return out


def featured(docs: DataFrame, open_model, extra: list[str], out) -> DataFrame:
    """Apply ``out = (schema, f(batch, features))`` to each batch of (doc_id, text, *extra)."""

    def scores(held, model):
        streams = [[stream(t) for t in b.column(1).to_pylist()] for b in held]
        ready = model.ready([s for x in streams for s in x])
        for b, x in zip(held, streams):
            rows = [features(w) for w in word_scores(x, ready)]
            yield out[1](b, np.array(rows, np.float64).reshape(len(rows), N_FEATURES))

    def run(batches):
        model, held, size = open_model(), [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= model.stretch:
                yield from scores(held, model)
                held, size = [], 0
        if held:
            yield from scores(held, model)

    return docs.select("doc_id", "text", *extra).mapInArrow(run, out[0])


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> tuple:
    """(means, scales, weights with the constant last) of a logistic regression, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def probability(x: np.ndarray, fit: tuple) -> np.ndarray:
    mean, scale, w = fit
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def opened(table: DataFrame, n: int, column: str):
    """A function that opens the model on an executor."""
    if n > SENT_GRAMS:
        uri = table._keyloom_path
        return lambda: Stored(uri, column)
    t = table.select("h", column).toArrow()
    keys = t.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sent = table.sparkSession.sparkContext.broadcast((keys[order], t.column(1).to_numpy()[order]))
    return lambda: Sent(*sent.value)


def trained(docs: DataFrame, labels: DataFrame, ws: Workspace):
    """(model, fit): what ``opened`` gives, and the regression; None without rows of both classes."""
    rows = with_labels(docs, labels, ws)
    grams = ws.save(gram_counts(rows), "grams")
    table = ws.save(ratios(grams, ws), "model")
    n = table.count()
    sample = rows.where(F.col("rest") == FIT_ON)
    size = ws.save(sample.select("doc_id"), "sample").count()
    if not n or not size:
        return None
    sample = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-size // FIT_ROWS)))) == 0)

    def out(b, x):
        return pa.RecordBatch.from_arrays([b.column(2), *(pa.array(c) for c in x.T)], names=["toxic", *(f"f{i}" for i in range(N_FEATURES))])

    got = featured(sample, opened(table, n, "fit"), ["toxic"], ("toxic boolean, " + ", ".join(f"f{i} double" for i in range(N_FEATURES)), out)).toArrow()
    if not got.num_rows:
        return None
    x = np.stack([got.column(1 + i).to_numpy() for i in range(N_FEATURES)], 1)
    y = got.column(0).to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    order = np.lexsort((y, *x.T))  # sums in one order, whatever the order of the rows
    return opened(table, n, "full"), regression(x[order], y[order])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs(doc_id, text)``; ``labels(doc_id, toxic)``."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    small_batches(spark)
    model = trained(docs, labels, ws)
    rows = docs.select("doc_id", empty_text().alias("text"))
    if model is None:
        out = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        open_model, fit = model

        def score(b, x):
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(probability(x, fit))], names=["doc_id", "score"])

        out = featured(rows, open_model, [], (f"doc_id {dict(docs.dtypes)['doc_id']}, score double", score))
    return out.select("doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
