"""Event streams: counts, inactivity sessions, correlation, throttling and admission, with event time.

Sources are files; a run takes what is there (``availableNow``) and writes to a table on the shared folder.
Event time and watermarks decide what is late; nothing depends on the wall clock.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.operators.shared import folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a folder or one file, as a stream with a timestamp in ``at``."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = spark.readStream.schema(schema)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        path, rows = sf_dir, rows.option("pathGlobFilter", "events.parquet")
    return rows.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, and read what it wrote."""
    spark = stream.sparkSession
    at = f"{folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{at}/rows").start()
    else:  # a complete or updated result replaces the one before
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def counts(stream: DataFrame, by: list[str]) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def with_heartbeat(stream: DataFrame, at: str, last, by: str) -> DataFrame:
    """``stream(by, at)`` and one row without a key at time ``last``, which moves the watermark past all events before."""
    spark = stream.sparkSession
    place = f"{folder(spark).rstrip('/')}/beat-{uuid.uuid4().hex[:12]}"
    beat = spark.range(1).select(F.lit(None).cast(dict(stream.dtypes)[by]).alias(by), F.lit(last).cast("timestamp").alias(at))
    beat.write.parquet(place)
    return stream.select(by, at).unionByName(spark.readStream.schema(beat.schema).parquet(place))


def sessions(stream: DataFrame, by: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after ``gap`` without an event; given out once the watermark has passed them."""
    return stream.withWatermark("at", late).groupBy(by, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(
        by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def correlated(opens: DataFrame, closes: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Closes of an open with the same key within an interval; others are ignored."""
    a = opens.withWatermark("at", late).select(F.col(key).alias("k1"), F.col("at").alias("opened"), F.col("event_id").alias("open_id"))
    b = closes.withWatermark("at", late).select(F.col(key).alias("k2"), F.col("at").alias("closed"), F.col("event_id").alias("close_id"))
    near = (F.col("k1") == F.col("k2")) & (F.col("closed") >= F.col("opened")) & (F.col("closed") <= F.col("opened") + F.expr(f"interval {within}"))
    return a.join(b, near).select(F.col("k1").alias(key), "open_id", "close_id")


def throttled(stream: DataFrame, key: str, gap_micros: int) -> DataFrame:
    """Events of a key that come more than ``gap_micros`` after the last accepted one, which the state keeps."""

    def accept(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        rows = pd.concat(list(parts)).sort_values(["micros", "event_id"])
        for micros, event_id in zip(rows["micros"].tolist(), rows["event_id"].tolist()):
            if last is None or micros - last > gap_micros:
                last = micros
                kept.append((k[0], event_id))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "event_id"])

    rows = stream.select(key, "event_id", F.unix_micros("at").alias("micros"))
    return rows.groupBy(key).applyInPandasWithState(accept, f"{key} long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def admitted(stream: DataFrame, parent: str, child: str, most: int) -> DataFrame:
    """(parent, child): the first ``most`` children of a parent to ask, kept in the state."""

    def accept(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = list(state.get[0]) if state.exists else []
        new = []
        rows = pd.concat(list(parts)).sort_values(["micros", "event_id"])
        for c in rows[child].tolist():
            if len(have) < most and c not in have:
                have.append(c)
                new.append((k[0], c))
        state.update((have,))
        yield pd.DataFrame(new, columns=[parent, child])

    rows = stream.select(parent, child, "event_id", F.unix_micros("at").alias("micros"))
    kinds = dict(rows.dtypes)
    return rows.groupBy(parent).applyInPandasWithState(accept, f"{parent} {kinds[parent]}, {child} {kinds[child]}", f"have array<{kinds[child]}>", "append", GroupStateTimeout.NoTimeout)


def fan_out(stream: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Each frame once for each child of its parent: a stream joined with a static table."""
    return stream.join(children, key)


def muted(stream: DataFrame, names: list[str], column: str) -> DataFrame:
    return stream.where(~F.col(column).isin(names)) if names else stream


class Consumers:
    """Consumers of messages by kind: each is a function of a DataFrame of the messages of its kind."""

    def __init__(self):
        self._of: dict = {}

    def register(self, kind, consumer) -> None:
        if kind in self._of:
            raise ValueError(f"a consumer of {kind!r} is there already")
        self._of[kind] = consumer

    def remove(self, kind) -> bool:
        return self._of.pop(kind, None) is not None

    def get(self, kind):
        return self._of.get(kind)

    def get_or_create(self, kind, make):
        if kind not in self._of:
            self._of[kind] = make()
        return self._of[kind]

    def deliver(self, messages: DataFrame, kind: str) -> None:
        """Give each consumer its messages, in the order of registration; those of other kinds are dropped."""
        for name, consumer in list(self._of.items()):
            consumer(messages.where(F.col(kind) == name))

    def run(self, stream: DataFrame, kind: str) -> None:
        """Deliver every micro-batch of a stream over what there is."""
        at = f"{folder(stream.sparkSession).rstrip('/')}/consumers-{uuid.uuid4().hex[:12]}"
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", at).foreachBatch(lambda batch, _: self.deliver(batch, kind)).start()
        query.awaitTermination()
