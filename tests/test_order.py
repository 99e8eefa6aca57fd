"""Places, neighbours and written pages where one feed holds nearly all entries."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import order, relate
from feedloom.sources import feeds as xml_feeds

ZERO = dt.datetime(2024, 1, 1)


def one_large_feed(n=6000):
    """Feed "b" has nine rows in ten; also a null feed, single rows, ties and missing times."""
    rng = random.Random(3)
    rows = [("b" if rng.random() < 0.9 else rng.choice(["a", "c", None, f"s{k}"]), k, ZERO + dt.timedelta(seconds=rng.randrange(2000)) if rng.random() < 0.6 else None) for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "37")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("by", ["time", "doc_pos", None])
def test_places(spark, small_batches, by):
    rows = one_large_feed()
    df = spark.createDataFrame(rows, "feed_key string, doc_pos long, time timestamp").repartition(5)
    got = {(r.feed_key, r.doc_pos): r["rank"] for r in relate.ranked(df, by).collect()}
    assert len(got) == len(rows)
    for feed in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == feed]
        own.sort(key=(lambda r: (-((r[2] or dt.datetime(1970, 1, 1)) - ZERO).total_seconds(), r[1])) if by == "time" else lambda r: r[1])
        assert [got[feed, r[1]] for r in own] == list(range(1, len(own) + 1))


def test_no_partition_holds_the_feed(spark):
    df = spark.createDataFrame(one_large_feed(), "feed_key string, doc_pos long, time timestamp")
    laid = order.laid_out(df, "feed_key", [F.col("doc_pos")])
    sizes = sorted(r["count"] for r in laid.groupBy(order.PART).count().collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_neighbours(spark, small_batches):
    rows = one_large_feed()
    df = spark.createDataFrame(rows, "feed_key string, doc_pos long, time timestamp").repartition(5)
    as_of = ZERO + dt.timedelta(days=9)
    got = {(r.feed_key, r.doc_pos): r.time for r in relate.estimate_times(df, F.lit(as_of).cast("timestamp")).collect()}
    second = dt.timedelta(seconds=1)
    for feed in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == feed), key=lambda r: r[1])
        for i, (_, pos, time) in enumerate(own):
            later = own[i + 1][2] if i + 1 < len(own) else None
            earlier = own[i - 1][2] if i else None
            assert got[feed, pos] == (time or (later + second if later else earlier - second if earlier else as_of))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, ZERO)], "feed_key string, doc_pos long, time timestamp")
    assert [tuple(r) for r in relate.ranked(df).collect()] == [("a", 1, ZERO, 1)]
    assert relate.ranked(df.limit(0)).count() == 0 and relate.estimate_times(df.filter("false"), F.current_timestamp()).count() == 0


def items_of(df):
    k = F.col("doc_pos").cast("string")
    return df.select("feed_key", "doc_pos", F.concat(F.lit("urn:"), k).alias("id"), F.concat(F.lit("t & "), k).alias("title"), F.lit("http://h.example.org/").alias("link"), F.lit("c").alias("content"), F.timestamp_seconds("doc_pos").alias("time"))


def heads_of(df):
    return df.select("feed_key").distinct().select("feed_key", F.lit("T").alias("title"), F.lit("http://h.example.org/").alias("link"), F.lit("s").alias("subtitle"))


def test_a_large_feed_is_written_in_pages(spark, tmp_path):
    """A hundred thousand entries of one feed, written by several tasks and read back in order."""
    n, path = 100_000, str(tmp_path / "feeds")
    df = spark.range(n).select(F.lit("big/é").alias("feed_key"), F.col("id").alias("doc_pos"))
    xml_feeds.save_feeds(heads_of(df), items_of(df), path, page=4000)
    docs = xml_feeds.read_saved(spark, path)
    heads = docs.select("feed_key", "page", F.regexp_count("xml", F.lit("<item>")).alias("n"), F.regexp_extract_all("xml", F.lit('rel="(?:previous|next)" href="([^"]*)"'), 1).alias("near")).orderBy("page").collect()
    assert [(r.feed_key, r.page, r.n) for r in heads] == [("big/é", k, 4000) for k in range(1, 26)]
    assert heads[0].near == ["big/é-000002.xml"] and heads[5].near == ["big/é-000005.xml", "big/é-000007.xml"] and heads[-1].near == ["big/é-000024.xml"]
    assert len([p for p in os.listdir(path) if p.startswith("part-")]) > 1
    e = xml_feeds.entries(docs, key="page", columns=["page", "doc_pos", "id", "title"])
    wrong = e.filter(F.concat(F.lit("urn:"), ((F.col("page") - 1) * 4000 + F.col("doc_pos")).cast("string")) != F.col("id"))
    assert e.count() == n and wrong.isEmpty()


@pytest.mark.parametrize("kind,version", [("rss", None), ("rss", 1.0), ("atom", None)])
def test_files_equal_the_strings(spark, tmp_path, kind, version):
    """What is streamed into files is what ``write_xml`` makes of a feed; entries of no feed are left out in both."""
    df = spark.createDataFrame([(f, k) for f in ("a", "b") for k in range(5)], "feed_key string, doc_pos long")
    heads, items = heads_of(df), items_of(df).unionByName(items_of(df.select(F.lit("none").alias("feed_key"), "doc_pos")))
    empty = heads.limit(1).withColumn("feed_key", F.lit("without entries"))
    heads = heads.unionByName(empty)
    path = str(tmp_path / "feeds")
    xml_feeds.save_feeds(heads, items, path, kind, version)
    saved = {r.feed_key: r.xml for r in xml_feeds.read_saved(spark, path).collect()}
    assert saved == {r.feed_key: r.xml for r in xml_feeds.write_xml(heads, items, kind, version).collect()}


def test_the_writer_takes_a_version_with_a_size(spark):
    """An enclosure without a size gives way to its first version that has one; without any a note stands for it."""
    e = "array<struct<href:string,type:string,file_size:bigint,versions:array<struct<href:string,type:string,file_size:bigint>>>>"
    parcels = [("a", None, None, [("b", "x/y", 0), ("c", "x/y", 7)]), ("d", None, 5, None), ("e", None, None, [])]
    df = spark.createDataFrame([(1, parcels)], f"k int, enclosures {e}")
    item = items_of(spark.createDataFrame([("f", 1)], "feed_key string, doc_pos long")).crossJoin(df.select("enclosures"))
    xml = xml_feeds.write_items(item).first().xml
    assert '<enclosure url="c" type="x/y" length="7"/><enclosure url="d" length="5"/><!-- an enclosure without a size' in xml and 'url="a"' not in xml
