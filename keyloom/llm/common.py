"""What the training-data operators share: tables, the shared folder, and graph components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; whole texts can be long, so a batch must stay small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where a scan has at most half as many partitions (few files of one row group each).

    For work that takes much longer than moving the rows; a scan of many partitions is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker gets at once (a setting of the session, not of the data)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def small_reads(spark: SparkSession, rows: int = BATCH_ROWS):
    """Bound how many rows a Parquet scan holds at once, for what is run inside."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "keyloom-shared")
    if "://" not in root and not root.startswith("file:"):
        root = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(
            spark._jvm.org.apache.hadoop.fs.Path(root)).toString()
    return root.rstrip("/")


class Workspace:
    """Tables and files of one run, in a folder of its own under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.drop, self.path)

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, survives lost executors."""
        at = self.folder(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._keyloom_path = at
        return out

    def drop(self, what) -> None:
        at = what if isinstance(what, str) else getattr(what, "_keyloom_path", None)
        if at is None:
            return
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone already; what is left is only a temporary table
            pass


def np_components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable position of each of ``n`` positions under the links (i, j).

    ``label`` may hold the roots of earlier links; it is updated and returned.
    """
    label = np.arange(n) if label is None else label
    i, j = np.asarray(i), np.asarray(j)
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        if not keep.any():
            break
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(spark: SparkSession, edges: DataFrame, ws: Workspace) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) per node of an edge.

    Each round maps every node to the neighbour (or itself) of least random rank, contracts the
    graph by that map and goes on with the links left; expected O(log n) rounds.  Nothing but a
    row count comes to the driver.  Hubs: minima are combined before the shuffle, and the joins
    run on written tables, so that adaptive execution can split a hub's rows.
    """
    edges = ws.save(edges.where("a <> b and a is not null and b is not null").select("a", "b"), "edges")
    maps: list[DataFrame] = []
    step = 0
    while not edges.isEmpty():
        step += 1
        rank = F.xxhash64("m", F.lit(step))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("m")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("m")))
        least = both.groupBy("node").agg(F.min(F.struct(rank.alias("r"), F.col("m"))).alias("x"))
        own = F.struct(F.xxhash64("node", F.lit(step)).alias("r"), F.col("node").alias("m"))
        to = ws.save(least.select("node", F.least("x", own)["m"].alias("root")), f"map{step}")
        maps.append(to)
        left = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        moved = left.select("b", "ra").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        moved = moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        new = ws.save(moved.distinct(), f"edges{step}")
        ws.drop(edges)
        edges = new
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("far"))
        out = ws.save(earlier.join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "map")
    return out


def empty_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def dealt_as_grid(rows: DataFrame, hot: int, ws: Workspace, counts: DataFrame | None = None) -> DataFrame:
    """Name the tasks of a self-join: adds ``key`` and ``own`` (rows are compared with all others of the task, not
    with those of the other side), drops ``top`` and ``same``.

    ``rows(top, same, side, node, ..)``: rows of one ``top`` are compared, all with each other if
    ``same``, else side 0 with side 1.  A ``top`` of more than ``hot`` rows is cut into parts by a hash
    of ``node``, and each pair of parts is a task of its own with the two parts as its sides.
    ``counts(top, n)`` may give the numbers of rows, if they are known.
    """
    counts = rows.groupBy("top").agg(F.count("*").alias("n")) if counts is None else counts
    many = counts.where(F.col("n") > hot)
    many = ws.save(many.select("top", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "hot")
    if many.isEmpty():
        return rows.withColumn("key", F.col("top")).withColumnRenamed("same", "own").drop("top")
    rows = rows.join(many, "top", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two, same = F.col("part"), F.col("x"), F.col("same")
    rows = rows.withColumn("p", F.when(same, F.least(one, two)).when(F.col("side") == 0, one).otherwise(two))
    rows = rows.withColumn("q", F.when(same, F.greatest(one, two)).when(F.col("side") == 0, two).otherwise(one))
    rows = rows.withColumn("own", same & (F.col("p") == F.col("q")))
    rows = rows.withColumn("side", F.when(same, (one > two).cast("int")).otherwise(F.col("side")))
    rows = rows.withColumn("key", F.when(F.col("parts") == 1, F.col("top")).otherwise(F.xxhash64("top", "p", "q")))
    return rows.drop("same", "top", "parts", "part", "x", "p", "q")


def by_key(batches, rows: int):
    """Arrow tables of about ``rows`` rows, from batches sorted by their first column, never cutting a key."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).to_batches()
            size = sum(x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bloom(hashes: DataFrame, n: int, most_bits: int) -> tuple[np.ndarray, int] | None:
    """A Bloom filter of ``n`` hashes as words of 64 bits, at most ``most_bits``; None if that would not tell much."""
    bits = 1 << max(16, (16 * n - 1).bit_length())
    if bits > most_bits:
        if 8 * n > most_bits:
            return None
        bits = most_bits

    import pyarrow as pa

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for x in bloom_places(h, bits):
                np.bitwise_or.at(words, x >> np.uint64(6), np.uint64(1) << (x & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "word"])

    rows = hashes.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words, bits


def bloom_places(h: np.ndarray, bits: int):
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def in_bloom(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for x in bloom_places(h, bits):
        out &= (words[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
    return out
