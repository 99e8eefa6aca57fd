"""Entries as a stream: dropping known ones, keeping answers that are due, windows and sessions, late rows, upserting a cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from feedloom.sources.fetch import FeedCache
from feedloom.sources.tables import shared_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of entries with their time."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.getFileStatus(jvm_path).isDirectory():  # a stream reads folders
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("time", F.col("ts").cast("timestamp"))


def new_entries(stream: DataFrame, key: list[str], delay: str = "30 days") -> DataFrame:
    """Entries whose key hasn't been seen within the watermark, which bounds the state: an entry that comes again later is new."""
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(key)


def posts_per_window(stream: DataFrame, key: str, width: str = "1 hour", delay: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Posts in windows of a width, which overlap where ``slide`` is less."""
    return stream.withWatermark("time", delay).groupBy(key, F.window("time", width, slide or width)).agg(F.count("*").alias("posts"))


def sessions(stream: DataFrame, key: str, gap: str | Column, delay: str = "2 hours") -> DataFrame:
    """Runs of posts that follow each other within ``gap``, which may be another interval for each row."""
    return stream.withWatermark("time", delay).groupBy(key, F.session_window("time", gap)).agg(F.count("*").alias("posts"), F.min("time").alias("first"), F.max("time").alias("last"))


def split_late(stream: DataFrame, on_time: str, late: str, checkpoint: str, delay: str = "2 hours", time: str = "time", available_now: bool = False) -> StreamingQuery:
    """Start a stream that writes every batch's rows to ``on_time``, but those that come too late to ``late``.

    A row is late when it is older than the newest row of all batches before by more than ``delay``: such rows are
    what windows drop without a word.  Rows without a time are late.  Both folders hold a folder a batch; a batch that
    runs again finds the same mark, the newest time so far, and writes the same rows.
    """
    marks = f"{checkpoint.rstrip('/')}-marks"

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = spark.read.parquet(f"{marks}/batch={batch - 1}").first()["newest"] if batch else None
        rows = rows.persist()
        mark = F.lit(before) - F.expr(f"INTERVAL {delay}")
        in_time = F.col(time).isNotNull() if before is None else F.coalesce(F.col(time) >= mark, F.lit(False))
        rows.filter(in_time).write.mode("overwrite").parquet(f"{on_time}/batch={batch}")
        rows.filter(~in_time).write.mode("overwrite").parquet(f"{late}/batch={batch}")
        rows.agg(F.greatest(F.max(time), F.lit(before).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={batch}")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class TimeToLive(StatefulProcessor):
    """For each address when its answer was taken and until when it lives; a timer drops both once that has passed.

    With ``names`` the answers that come when the one before no longer lives are given out, without it the answers
    that stopped living: (address, taken at, lived until) in microseconds.
    """

    def __init__(self, floor: int, names: list[str] | None):
        self.floor, self.names = floor, names

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = [r for r in rows if len(r)]
        if not given:
            return
        batch = pd.concat(given, ignore_index=True).sort_values("feedloom_at", kind="stable")
        known = self.kept.get() if self.kept.exists() else None
        at, until = known if known else (None, None)
        first, due, over = until, [], []
        for when, span in zip(batch["feedloom_at"], batch["feedloom_ttl"], strict=True):
            fresh = until is None or when > until
            if fresh:
                over += [] if until is None else [(key[0], at, until)]
                at, until = int(when), int(when) + max(int(span), self.floor) * 1_000_000
            due.append(fresh)
        if until != first:
            if first is not None:
                self.handle.deleteTimer(_timer(first))
            self.kept.update((at, until))
            self.handle.registerTimer(_timer(until))
        if self.names:  # the frame's names went through a named tuple, which changes some
            yield batch[due].iloc[:, : len(self.names)].set_axis(self.names, axis=1)
        else:
            yield pd.DataFrame(over, columns=["key", "at", "until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, until = self.kept.get()
        self.kept.clear()
        if not self.names:
            yield pd.DataFrame([(key[0], at, until)], columns=["key", "at", "until"])

    def close(self) -> None:
        pass


def _timer(until: int) -> int:
    """The first millisecond after a time in microseconds."""
    return until // 1000 + 1


#: State with timers needs this provider; it's set for streams that start afterwards, others keep what their checkpoint says.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _living(polls: DataFrame, key: str, time: str, ttl: str, floor: int, delay: str, names: list[str] | None, schema) -> DataFrame:
    polls.sparkSession.conf.set(*PROVIDER)
    rows = polls.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.withColumn("feedloom_time", F.greatest(F.col(time), F.timestamp_millis(F.lit(1)))).withWatermark("feedloom_time", delay)  # 1970 itself counts as late
    rows = rows.withColumns({"feedloom_at": F.unix_micros(time), "feedloom_ttl": F.coalesce(F.col(ttl).cast("long"), F.lit(0))})
    return rows.groupBy(key).transformWithStateInPandas(TimeToLive(floor, names), schema, "Append", "EventTime")


def within_ttl(polls: DataFrame, key: str = "href", time: str = "last_retrieved", ttl: str = "time_to_live", floor: int = 1800, delay: str = "1 hour") -> DataFrame:
    """Of the answers for each address those that come when the one kept before has expired, after ``ttl`` seconds and ``floor`` at least.

    The state is two numbers an address while its answer lives, by the watermark; then a timer drops it.  Answers
    without address or time are dropped, and so are those later than ``delay``.
    """
    return _living(polls, key, time, ttl, floor, delay, polls.columns, polls.schema)


def expiries(polls: DataFrame, key: str = "href", time: str = "last_retrieved", ttl: str = "time_to_live", floor: int = 1800, delay: str = "1 hour") -> DataFrame:
    """The kept answers of ``within_ttl`` when they expire: address, ``retrieved`` and ``expired``, to poll those addresses again."""
    schema = StructType([StructField("key", polls.schema[key].dataType), StructField("at", LongType()), StructField("until", LongType())])
    out = _living(polls, key, time, ttl, floor, delay, None, schema)
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias("retrieved"), F.timestamp_micros("until").alias("expired"))


def upsert_into(answers: DataFrame, cache: FeedCache, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start a stream that saves every batch of cache rows to a cache; of one address the row retrieved last stays.

    A batch that runs again after a failure saves the same rows, so the cache doesn't change.
    """
    writer = answers.writeStream.foreachBatch(lambda rows, _: cache.save(rows)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its output as a table."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out)
    else:  # the last complete result replaces those before it
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).outputMode(mode)
    query.option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
