"""Length-prefixed record streams and a self-describing table codec, batch-wise through Arrow."""

from __future__ import annotations

import datetime
import decimal
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STYLES = ("base128", "fixed32", "fixed32be")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def frame(record: bytes, style: str, tag: int | None = None) -> bytes:
    """A record behind its length; with base128 a field tag may stand before."""
    if style == "base128":
        return (b"" if tag is None else varint(tag << 3 | 2)) + varint(len(record)) + record
    return struct.pack("<I" if style == "fixed32" else ">I", len(record)) + record


def frames(raw: bytes, style: str, tag: int | None = None) -> Iterator[bytes]:
    """The records of a stream; of tagged ones only those with this tag."""
    at = 0
    while at < len(raw):
        found = None
        if style == "base128":
            if tag is not None:
                found, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
        else:
            n = struct.unpack_from("<I" if style == "fixed32" else ">I", raw, at)[0]
            at += 4
        if at + n > len(raw):
            raise ValueError("the stream ends inside a record")
        if tag is None or found >> 3 == tag:
            yield raw[at : at + n]
        at += n


def framed(rows: DataFrame, column: str, style: str, tag: int | None = None) -> DataFrame:
    """(stream): the binary values of each batch as one stream."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(frame(r, style, tag) for r in b.column(0).to_pylist() if r is not None)], pa.binary())], names=["stream"])

    return rows.select(F.col(column)).mapInArrow(run, "stream binary")


def unframed(streams: DataFrame, column: str, style: str, tag: int | None = None) -> DataFrame:
    """(record): what ``framed`` put into streams."""

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(frames(raw, style, tag)), pa.binary())], names=["record"])

    return streams.select(F.col(column)).mapInArrow(run, "record binary")


def read_framed(spark: SparkSession, path: str, style: str = "base128", tag: int | None = None) -> DataFrame:
    """Records of the length-prefixed files under a path."""
    return unframed(spark.read.format("binaryFile").load(path), "content", style, tag)


def playback(spark: SparkSession, path: str, style: str = "base128", tag: int | None = None, step: int = 1) -> DataFrame:
    """(record) of the same files as a stream that takes ``step`` files at a time."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", step).load(path)
    return unframed(files, "content", style, tag)


def write_framed(rows: DataFrame, column: str, path: str, style: str = "base128", tag: int | None = None) -> None:
    """One file of length-prefixed records for each partition, under its name only when it is complete."""
    import uuid

    from pyarrow import fs
    from pyspark import TaskContext

    uri = path if "://" in path else "file://" + path.removeprefix("file:")

    def run(batches):
        where, root = fs.FileSystem.from_uri(uri)
        where.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.bin"
        part = f"{root}/_{uuid.uuid4().hex[:8]}.part"
        with where.open_output_stream(part) as out:
            for b in batches:
                for r in b.column(0).to_pylist():
                    if r is not None:
                        out.write(frame(r, style, tag))
        where.move(part, name)
        yield from ()

    rows.select(F.col(column)).mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


# ---- table codec: name, columns, rows that hold only their cells that are not null ----

_KINDS = {"smallint": 1, "int": 2, "bigint": 3, "string": 4, "double": 5, "date": 6, "timestamp_ntz": 7}


def _kind(t: T.DataType) -> int:
    return 8 if isinstance(t, T.DecimalType) else _KINDS[t.simpleString()]


def _put(v, kind: int) -> bytes:
    if kind in (1, 2, 3):
        return struct.pack("<q", v)
    if kind == 5:
        return struct.pack("<d", v)
    if kind == 6:
        return struct.pack("<i", v.toordinal())
    if kind == 7:
        d = v - datetime.datetime(1970, 1, 1)
        return struct.pack("<q", (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds)
    text = str(v).encode()
    return varint(len(text)) + text


def _get(raw: bytes, at: int, kind: int):
    if kind in (1, 2, 3):
        return struct.unpack_from("<q", raw, at)[0], at + 8
    if kind == 5:
        return struct.unpack_from("<d", raw, at)[0], at + 8
    if kind == 6:
        return datetime.date.fromordinal(struct.unpack_from("<i", raw, at)[0]), at + 4
    if kind == 7:
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=struct.unpack_from("<q", raw, at)[0]), at + 8
    n, at = read_varint(raw, at)
    text = raw[at : at + n].decode()
    return (decimal.Decimal(text) if kind == 8 else text), at + n


def encode_table(rows: DataFrame, name: str) -> DataFrame:
    """(table): each batch as a self-describing table."""
    columns = [(f.name, _kind(f.dataType), f.dataType.simpleString()) for f in rows.schema.fields]

    def run(batches):
        for b in batches:
            out = bytearray(frame(name.encode(), "base128") + varint(len(columns)))
            for n, k, t in columns:
                out += frame(n.encode(), "base128") + bytes([k]) + frame(t.encode(), "base128")
            out += varint(b.num_rows)
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out += varint(sum(v is not None for v in row))
                for i, v in enumerate(row):
                    if v is not None:
                        out += varint(i) + _put(v, columns[i][1])
            yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["table"])

    return rows.mapInArrow(run, "table binary")


def _head(raw: bytes):
    n, at = read_varint(raw, 0)
    name, at = raw[at : at + n].decode(), at + n
    count, at = read_varint(raw, at)
    columns = []
    for _ in range(count):
        n, at = read_varint(raw, at)
        column, at = raw[at : at + n].decode(), at + n
        kind, at = raw[at], at + 1
        n, at = read_varint(raw, at)
        columns.append((column, kind, raw[at : at + n].decode()))
        at += n
    return name, columns, at


def table_schema(tables: DataFrame) -> tuple[str, T.StructType]:
    """The name and schema that the first table carries."""
    name, columns, _ = _head(bytes(tables.select("table").first()[0]))
    return name, T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, _, t in columns])


def decode_table(tables: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of encoded tables; a cell that is not there is null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                _, columns, at = _head(raw)
                n, at = read_varint(raw, at)
                cells = [[None] * n for _ in columns]
                for r in range(n):
                    full, at = read_varint(raw, at)
                    for _ in range(full):
                        i, at = read_varint(raw, at)
                        cells[i][r], at = _get(raw, at, columns[i][1])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], schema=arrow)

    return tables.select("table").mapInArrow(run, schema)
