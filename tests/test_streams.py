"""State with timers, sessions, late rows and polls that replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from feedloom.sources.tables import shared_path
from feedloom.streaming import streams

ZERO = dt.datetime(2024, 1, 1)


def deliver(spark, rows, schema, batches):
    """Rows as files, one a batch, and the stream that reads one at a time."""
    folder = shared_path(spark, "deliveries")
    for k in range(batches):
        spark.createDataFrame([r for i, r in enumerate(rows) if i * batches // len(rows) == k], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def polled(n=400, seed=1):
    rng = random.Random(seed)
    at, out = 0, []
    for _ in range(n):
        at += rng.randint(1, 900)
        out.append((rng.choice("abcde"), ZERO + dt.timedelta(seconds=at, microseconds=rng.randint(0, 999999)), rng.choice([None, 0, 100, 3600, 9000]), at))
    return out + [(None, ZERO, 1, 0), ("a", None, 1, 0)]


def kept_of(rows):
    last, out = {}, []
    for href, when, ttl, mark in sorted((r for r in rows if r[0] and r[1]), key=lambda r: r[1]):
        if href not in last or when > last[href]:
            last[href] = when + dt.timedelta(seconds=max(ttl or 0, 1800))
            out.append((href, when, last[href]))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_state_with_timers(spark, batches):
    """However the polls are cut into batches, the same are due, and each kept one expires once."""
    rows = polled()
    schema = "href string, last_retrieved timestamp, time_to_live int, `_odd name` long"
    want = kept_of(rows)
    kept = streams.drain(streams.within_ttl(deliver(spark, rows, schema, batches))).collect()
    assert sorted((r.href, r.last_retrieved) for r in kept) == sorted(w[:2] for w in want)
    assert all(r["_odd name"] == int((r.last_retrieved - ZERO).total_seconds()) for r in kept)
    over = streams.drain(streams.expiries(deliver(spark, rows, schema, batches))).collect()
    mark = max(r[1] for r in rows if r[1]) - dt.timedelta(hours=1)
    final = {h: (h, w, u) for h, w, u in want}
    assert sorted(tuple(r) for r in over) == sorted(w for w in want if w != final[w[0]] or w[2] < mark)


def test_timers_bound_the_state(spark):
    """Addresses that are polled once leave no state behind when their time has passed."""
    rows = [(f"h{k}", ZERO + dt.timedelta(hours=k), 60, k) for k in range(40)]
    stream = streams.within_ttl(deliver(spark, rows, "href string, last_retrieved timestamp, time_to_live int, mark long", 8))
    query = stream.writeStream.format("noop").option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]
    assert len(held) >= 8 and max(held) < 30 and held[-1] < 8


def test_sessions_by_their_own_gap(spark):
    rows = [(k, ZERO + dt.timedelta(minutes=m), m) for k, gap in ((1, 10), (2, 30)) for m in (0, 9, 20, 45, 76, 200)]
    stream = deliver(spark, rows, "k long, time timestamp, m long", 1)
    gap = F.when(F.col("k") == 1, "10 minutes").otherwise("30 minutes")
    out = streams.drain(streams.sessions(stream, "k", gap), "complete").orderBy("k", "first").collect()
    assert [(r.k, r.posts) for r in out] == [(1, 2), (1, 1), (1, 1), (1, 1), (1, 1), (2, 4), (2, 1), (2, 1)]
    slid = streams.drain(streams.posts_per_window(stream, "k", "1 hour", slide="30 minutes"), "complete").filter("k = 1").orderBy("window.start")
    assert [r.posts for r in slid.collect()] == [3, 4, 2, 1, 1, 1]


def test_late_rows_go_aside_and_batches_replay(spark):
    """Rows older than the newest time so far by more than the delay; a restart without its last commit writes the same."""
    minutes = [[0, 10, 50], [100, 45, 20, None], [130, 99, 5]]
    rows = [(ZERO + dt.timedelta(minutes=m) if m is not None else None, m if m is not None else -1) for b in minutes for m in b]
    folder, on_time, late, progress = (shared_path(spark, t) for t in ("deliveries", "on-time", "late", "progress"))
    for b in minutes:
        spark.createDataFrame(rows[: len(b)], "time timestamp, m long").coalesce(1).write.mode("append").parquet(folder)
        rows = rows[len(b) :]
    stream = spark.readStream.schema("time timestamp, m long").option("maxFilesPerTrigger", 1).parquet(folder)
    read = lambda p: sorted((r.batch, r.m) for r in spark.read.parquet(p).collect())
    streams.split_late(stream, on_time, late, progress, "30 minutes", available_now=True).awaitTermination()
    want = ([(0, 0), (0, 10), (0, 50), (1, 45), (1, 20), (1, 100), (2, 99), (2, 130)], [(1, -1), (2, 5)])
    assert (read(on_time), read(late)) == tuple(map(sorted, want))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(progress).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(path(f"{progress}/commits/2"), False)
    streams.split_late(stream, on_time, late, progress, "30 minutes", available_now=True).awaitTermination()
    assert (read(on_time), read(late)) == tuple(map(sorted, want))
