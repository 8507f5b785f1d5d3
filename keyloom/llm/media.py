"""Media columns: content-addressed payloads in tar shards, read by ranges.

Payloads are packed, as 8-bit grey PNG images ``WIDTH`` samples wide, into tar shards on the shared folder; a
member is named by the SHA-256 of its payload and has one place in all shards.  Payloads that no other row has are packed
where they are read; of the others, told by a Bloom filter of repeated hashes while that fits in ``BLOOM_BITS``, one copy
each goes through a shuffle (after partial sums) and is packed there.  A row holds only (digest, shard, offset,
length).  Metadata columns come from reads of the first ``HEAD`` bytes of a member; whole members are read only where
the samples themselves are asked for.

Defined cases: null and empty texts are a payload of ``WIDTH`` zero bytes; a payload's length is a
multiple of ``WIDTH``; equal texts have equal members and values; a payload larger than a shard has a
shard to itself; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, bloom, empty_text, in_bloom, small_batches
from keyloom.llm.files import Output, store

WIDTH = 64
BLOOM_BITS = 1 << 28
SHARD_BYTES = 1 << 28
LEVEL = 3
#: Signature and IHDR of a PNG.
HEAD = 33
READ_BYTES = 1 << 23
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits of a sample) from the first bytes of a member."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> np.ndarray:
    """The samples, line by line."""
    width, height, bits = header(data)
    if bits != 8:
        raise ValueError("not 8-bit samples")
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def packed(rows: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, digest, path, offset, length) of each of ``rows(doc_id, raw)``, whose payloads go to shards in ``folder``."""

    def run(batches):
        task, shard, out, held = TaskContext.get().partitionId(), 0, None, {}
        for b in batches:
            rows = []
            for raw in b.column(1):
                payload = padded(raw.as_py())
                digest, n = hashlib.sha256(payload).digest(), len(raw.as_buffer())
                at = held.get(digest)
                if at is None:
                    image = to_png(payload)
                    if out and out.size + len(image) > SHARD_BYTES:
                        out.write(bytes(1024))
                        out.close()
                        out, shard = None, shard + 1
                    out = out or Output(f"{folder}/shard-{task:06d}-{shard:04d}.tar")
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    out.write(info.tobuf(tarfile.PAX_FORMAT))
                    at = held[digest] = (out.uri, out.size, len(image))
                    out.write(image)
                    out.write(bytes(-len(image) % 512))
                rows.append((n, digest.hex(), *at))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "digest", "path", "offset", "length"])
        if out:
            out.write(bytes(1024))
            out.close()

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, digest string, path string, offset long, length long")


def pack(docs: DataFrame, folder: str, ws: Workspace) -> DataFrame:
    """Write the shards; (doc_id, n_bytes, digest, path, offset, length) of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.encode(empty_text(), "UTF-8").alias("raw"), F.xxhash64(empty_text()).alias("h"))
    twice = ws.save(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    known = bloom(twice, twice.count(), BLOOM_BITS)
    if known is None:
        repeated = F.lit(True)
    else:
        sent = spark.sparkContext.broadcast(known)

        @F.pandas_udf("boolean")
        def repeated_hash(h: pd.Series) -> pd.Series:
            return pd.Series(in_bloom(h.to_numpy().view(np.uint64), *sent.value))

        repeated = repeated_hash("h")
    index = ws.save(packed(rows.where(~repeated).select("doc_id", "raw"), f"{folder}/single"), "index")
    # of the others one copy each, and narrow rows that learn where it is
    others = rows.where(repeated)
    narrow = others.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("name"))
    texts = others.select(F.sha2("raw", 256).alias("name"), "raw").groupBy("name").agg(F.first("raw").alias("raw"))
    places = ws.save(packed(texts.select(F.col("name").alias("doc_id"), "raw"), f"{folder}/repeated"), "places")
    places = places.select(F.col("doc_id").alias("name"), "digest", "path", "offset", "length")
    more = ws.save(narrow.join(places, "name").select(*index.columns), "index-of-repeated")
    return index.unionByName(more)


def by_place(index: DataFrame) -> DataFrame:
    """Rows dealt so that a task reads neighbouring members, about READ_BYTES of them."""
    n = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    return index.repartition(n, "path", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("path", "offset")


class Shards:
    """Range reads; the shard read last stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file:
                self.file.close()
            fs, name = store(path)
            self.path, self.file = path, fs.open_input_file(name)
        return self.file.read_at(length, offset)


def with_headers(index: DataFrame) -> DataFrame:
    """``index`` with (width, height, bits), from reads of HEAD bytes each."""

    def run(batches):
        shards = Shards()
        for b in batches:
            found = [header(shards.read(p, o, HEAD)) for p, o in zip(b.column("path").to_pylist(), b.column("offset").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in found], pa.int32()) for i in range(3))], names=[*b.schema.names, "width", "height", "bits"])

    schema = ", ".join(f"{n} {t}" for n, t in index.dtypes) + ", width int, height int, bits int"
    return index.mapInArrow(run, schema)


def feature(samples: np.ndarray, bits: int) -> str:
    """Size, mean sample, shares of eight ranges of samples, and a 64-bit average hash."""
    flat = samples.ravel()
    bins = np.bincount(flat >> 5, minlength=8) * 1000 // len(flat)
    cells = np.array_split(flat, 64)
    means = np.array([int(c.sum(dtype=np.int64)) * 1000 // max(1, len(c)) for c in cells])
    bitsum = int.from_bytes(np.packbits(means * 64 > means.sum()).tobytes(), "big")
    return f"{samples.shape[1]}x{samples.shape[0]}x{bits} mean={int(flat.sum(dtype=np.int64)) * 1000 // len(flat)} bins={','.join(map(str, bins))} ahash={bitsum:016x}"


def read_back(index: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all but
    the first two from the stored bytes, and the feature's size from the metadata columns."""
    small_batches(index.sparkSession)

    def run(batches):
        shards, last, seen = Shards(), None, None
        for b in batches:
            rows = []
            for path, offset, length, *shape in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length", "width", "height", "bits"))):
                if (path, offset) != last:
                    data = shards.read(path, offset, length)
                    samples = from_png(data)
                    if header(data) != tuple(shape):
                        raise ValueError("the header has changed")
                    payload = samples.tobytes()
                    last = path, offset
                    seen = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, shape[2]))
                rows.append(seen)
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(index.dtypes)["doc_id"]
    return with_headers(by_place(index)).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text and read it back (see ``read_back``)."""
    ws = Workspace(docs.sparkSession, "media")
    return read_back(pack(docs, ws.folder("shards"), ws))
