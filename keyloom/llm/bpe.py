"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes, the table holds for each prefix the one token that the prefix's encoding
ends with.  A token t that ends at i is that token if it follows on the last token of the prefix
before it: the pair must come out of the merges unchanged.  Exactly one token passes, so an
encoding is read off backwards, appending bytes never changes an entry, and after an edit only
entries from the edit on are computed anew, until they agree with the old ones over the length of the
longest token (``PrefixTable``).

Texts are split by the tokenizer's pattern and each match is encoded by itself; a match that is
itself in the vocabulary is that one token.  Defined cases: null and empty texts have no tokens;
rows are encoded whole, one by one; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import empty_text, small_batches

#: Pieces in each of the two generations that a worker remembers.
REMEMBERED = 500_000
#: Longer pieces are not remembered.
LONG_PIECE = 64


class Vocabulary:
    """Ranks by bytes, and what the merges say about tokens and pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        #: The tokens that the merges make, read backwards, as a tree; -1 holds the token that ends there.
        self.ends: dict = {}
        self.longest = max(map(len, ranks), default=1)
        for token in ranks:
            if self.stands(token):
                node = self.ends
                for byte in reversed(token):
                    node = node.setdefault(byte, {})
                node[-1] = token

    @classmethod
    def read(cls, lines: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)})

    def fresh(self) -> Vocabulary:
        """The same vocabulary without what it has learnt of pairs."""
        out = object.__new__(Vocabulary)
        out.__dict__ = self.__dict__ | {"_pairs": {}, "_spines": {}}
        return out

    def merged(self, raw: bytes) -> list[bytes]:
        """The plain rule: join the neighbours of least rank, leftmost first, until none is left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            least = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], 1 << 60)) is not None)
            if least[0] == 1 << 60:
                break
            i = least[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for one byte or a token that no merges make."""
        if token not in self._halves:
            parts, found = [token[i : i + 1] for i in range(len(token))], None
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                found = parts[0], parts[1]
            self._halves[token] = found
        return self._halves[token]

    def stands(self, token: bytes) -> bool:
        """Whether the merges make this token of its own bytes."""
        return len(token) == 1 or self.halves(token) is not None

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at one end of this one while it is being merged, each with the rank that ends it."""
        key = token, side
        found = self._spines.get(key)
        if found is None:
            found, ends = [], 1 << 60
            while True:
                found.append((token, ends))
                if len(token) == 1:
                    break
                ends = self.ranks[token]
                token = self.halves(token)[side]
            self._spines[key] = found
        return found

    def follows(self, left: bytes, right: bytes) -> bool:
        """Whether the merges keep this pair as it is: no merge across its middle ever comes first.

        Of equal ranks the leftmost merge comes first, hence ``<`` on the left side and ``<=`` on the right.
        """
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            rank, found = self.ranks.get, True
            for a, a_ends in self.spine(left, 1):
                for b, b_ends in self.spine(right, 0):
                    across = rank(a + b)
                    if across is not None and across < a_ends and across <= b_ends:
                        found = False
                        break
                if not found:
                    break
            self._pairs[left, right] = found
        return found


class PrefixTable:
    """The last token of each prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last, self.computed = vocabulary, b"", [], 0
        self.append(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self.fill(len(self.raw))

    def fill(self, upto: int) -> None:
        """The entries from the last known one to ``upto``."""
        v, last, known, raw = self.vocabulary, self.last, self.vocabulary._pairs.get, self.raw
        self.computed += upto - len(last)
        for end in range(len(last), upto):
            node, start = v.ends, end
            while True:  # along the tokens that end here, from short to long
                node = node.get(raw[start])
                if node is None or start < 0:
                    raise ValueError("the vocabulary lacks a byte")
                token = node.get(-1)
                if token is not None:
                    if not start:
                        last.append(token)
                        break
                    found = known((last[start - 1], token))
                    if found or found is None and v.follows(last[start - 1], token):
                        last.append(token)
                        break
                start -= 1

    def edit(self, at: int, removed: int, put: bytes) -> None:
        """Replace ``removed`` bytes at ``at``.

        What stands before them is not computed again, and neither is what follows once the new entries are the old
        ones over the length of the longest token: no later entry looks further back.
        """
        old, step = self.last, self.vocabulary.longest
        self.raw = self.raw[:at] + put + self.raw[at + removed :]
        self.last, moved = old[:at], len(put) - removed
        self.fill(at + len(put))
        while len(self.last) < len(self.raw):
            here = len(self.last)
            self.fill(min(here + step, len(self.raw)))
            n = len(self.last)
            if n - here == step and self.last[here:] == old[here - moved : n - moved]:
                self.last += old[n - moved :]

    def become(self, raw: bytes, same: int | None = None) -> None:
        """Go over to other bytes, keeping what the common prefix (``same`` bytes, if known) has."""
        if same is None:
            old, same, most = self.raw, 0, min(len(raw), len(self.raw))
            while same < most and raw[same] == old[same]:
                same += 1
        self.raw = raw[:same]
        del self.last[same:]
        self.append(raw[same:])

    def ids(self) -> list[int]:
        out, at = [], len(self.raw)
        while at:
            token = self.last[at - 1]
            out.append(self.vocabulary.ranks[token])
            at -= len(token)
        return out[::-1]


class Tokenizer:
    """Encoding and decoding of whole texts; remembers pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern).findall
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not seen yet, in their order: each keeps what the table of the one before it has of their common prefix."""
        ranks, table = self.vocabulary.ranks, PrefixTable(self.vocabulary)
        for raw, text in sorted([(p.encode(), p) for p in pieces]):
            whole = ranks.get(raw)
            if whole is None:
                table.become(raw)
                self.seen[text] = tuple(table.ids())
            else:
                self.seen[text] = (whole,)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.pieces(t) for t in texts]
        seen = self.seen
        new = {p for p in set().union(*split) if p not in seen}
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen, self.older = {}, self.seen
            new = set().union(*split)
        if self.older:
            for p in [p for p in new if p in self.older]:
                self.seen[p] = self.older[p]
                new.discard(p)
        self.learn(new)
        of = self.seen.__getitem__
        out = [list(chain.from_iterable(map(of, ps))) for ps in split]
        for p in [p for p in new if len(p) > LONG_PIECE]:
            del self.seen[p]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in ids])


def tokenizer(lines: bytes, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file.

    A Python worker keeps the vocabulary, which no data changes, from task to task, in a module of its own (this one is
    sent anew with each task).  What a task has seen of texts goes with it.
    """
    kept = sys.modules.setdefault("_keyloom_kept", types.ModuleType("_keyloom_kept")).__dict__.setdefault("vocabularies", {})
    key = hashlib.sha256(lines).digest()
    if key not in kept:
        kept.clear()
        kept[key] = Vocabulary.read(lines)
    return Tokenizer(kept[key].fresh(), pattern)


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of ``docs(doc_id, text)``; ``lines`` is a rank file's content.

    The ranks go to the executors as a broadcast: a vocabulary has a fixed size, whatever the data.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(lines)

    def run(batches):
        t = tokenizer(sent.value, pattern)
        for b in batches:
            ids = t.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded binary")


def token_rows(docs: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids, and whether they decode to the text's bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(lines)

    def run(batches):
        t = tokenizer(sent.value, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = t.encode_batch(texts)
            same = [t.decode(i) == x.encode() for i, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                                             names=["doc_id", "n_tokens", "ids", "round_trip"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def digests(docs: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encoded`` makes."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(lines)

    def run(batches):
        t = tokenizer(sent.value, pattern)
        names = {i: str(i) for i in t.vocabulary.tokens}
        for b in batches:
            n, one, two = [], [], []
            for ids in t.encode_batch(b.column(1).to_pylist()):
                n.append(len(ids))
                one.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                two.append(hashlib.sha256(t.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
