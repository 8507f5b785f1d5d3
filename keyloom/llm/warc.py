"""WARC archives as chunked record tables.

Writing: one gzipped archive per task, one gzip member per record; of pages with equal payloads of at
least ``REVISIT_BYTES``, the one with the largest page_id is a response and the others are revisit
records without payload.  Reading: each archive is streamed into rows (record, chunk number), no row
longer than a chunk, each with the SHA-1 and the byte count of the payload so far; the last chunk of
a record thus has the digest of the whole, though no task ever holds the whole.

Defined cases: a null html is an empty payload; a null url is written as an empty URI and read as
null; a null page_id is written as such and is never referred to unless all equal payloads have none;
rows repeated with one page_id and payload are all responses if that page_id is the largest; an empty
table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, small_batches
from keyloom.llm.files import Output, store

REVISIT_BYTES = 1000
CHUNK = 1 << 16
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(rid: str):
    n = rid.removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n else None


def record(page_id, url, payload, refers_to, kind: str):
    """The gzipped pieces of one record; the payload is any buffer and is never copied whole."""
    sha, view = hashlib.sha1(), memoryview(payload)
    parts = [view[i : i + CHUNK] for i in range(0, len(view), CHUNK)]
    for part in parts:
        sha.update(part)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(view)}\r\n\r\n".encode()
    size = len(http) + (0 if kind == "revisit" else len(view))
    uri = "" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    yield z.compress("\r\n".join(["WARC/1.1", *head, "", ""]).encode() + http)
    if kind != "revisit":
        for part in parts:
            yield z.compress(part)
    yield z.compress(b"\r\n\r\n") + z.flush()


def with_roles(pages: DataFrame, ws: Workspace) -> DataFrame:
    """pages(page_id, url, payload, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    # one row for each payload that repeats; combined before the shuffle
    twins = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("chosen")).where("n > 1").select("digest", "chosen")
    twins = ws.save(twins, "twins")  # written, so that its size decides how it is joined
    return rows.join(twins, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("chosen"), F.col("chosen")).when(
        F.col("page_id").isNull(), F.col("chosen")).alias("refers_to"))


def write(pages: DataFrame, folder: str, ws: Workspace) -> DataFrame:
    """Write the archives; one row (path, records, bytes) for each."""
    small_batches(pages.sparkSession)

    def run(batches):
        out, n, uri = None, 0, f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        for b in batches:
            for page_id, url, refers_to, payload in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), b.column(2)):
                out = out or Output(uri)
                kind = "response" if refers_to is None else "revisit"
                for piece in record(page_id, url, payload.as_buffer(), refers_to, kind):
                    out.write(piece)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n]), pa.array([out.size])], names=["path", "records", "bytes"])

    return ws.save(with_roles(pages, ws).mapInArrow(run, "path string, records long, bytes long"), "archives")


def lines(f) -> dict[str, str]:
    """Header lines up to the empty one; the first is under ''."""
    out = {"": f.readline().decode().rstrip("\r\n")}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
        out["#"] = str(int(out.get("#", 0)) + len(line))
    return out


def chunks_of(f, chunk: int):
    """(head, HTTP head, chunk number, bytes, SHA-1 so far, byte count so far, last) along one archive."""
    while True:
        head = lines(f)
        if not head[""]:
            return
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        size = int(head["content-length"])
        http = lines(f)
        left = size - len(http[""]) - 2 - int(http.get("#", 0)) - 2
        sha, n, done = hashlib.sha1(), 0, 0
        while True:
            data = f.read(min(chunk, left)) if left else b""
            left -= len(data)
            sha.update(data)
            done += len(data)
            if left and not data:
                raise ValueError("the archive ends inside a record")
            yield head, http, n, data, sha.hexdigest(), done, not left
            n += 1
            if not left:
                break
        f.readline()
        f.readline()


_COLUMNS = "record_id string, page_id long, url string, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no int, data binary, sha1_so_far string, bytes_so_far long, is_last boolean"


def read(spark, paths: list[str], chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of some archives; without ``data`` the bytes stay in the reader."""
    n = max(1, len(paths))

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                if i >= len(paths):
                    continue
                fs, path = store(paths[i])
                with fs.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as f:
                    rows: list[tuple] = []
                    for head, http, no, part, sha, done, last in chunks_of(f, chunk):
                        kind = head["warc-type"]
                        declared = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if last and kind == "response" and sha != declared:
                            raise ValueError(f"damaged payload in {head['warc-record-id']}")
                        to = head.get("warc-refers-to")
                        rows.append((head["warc-record-id"], page_of(head["warc-record-id"]), head["warc-target-uri"] or None, kind, page_of(to) if to else None,
                                     declared, int(http["content-length"]), no, part if data else None, sha, done, last))
                        if len(rows) >= 256:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return spark.range(0, n, 1, n).mapInArrow(run, _COLUMNS)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives and read them back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to) of each record."""
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    # the list of archives has one entry per writing task
    paths = sorted(r[0] for r in write(pages, ws.folder("warc"), ws).select("path").collect())
    last = read(spark, paths, data=False).where("is_last")
    full = F.col("record_type") == "response"
    return last.select("page_id", F.when(full, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
                       F.when(full, F.col("sha1_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to")
