"""Relations between feeds and entries: inheritance, estimation, order, merging, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .order import places, with_neighbours

SORTABLE = ("time", "title", "guid", "doc_pos", "updated", "published", "link")


def inherit(entries: DataFrame, feeds: DataFrame, columns: list[str], key: str = "feed_key") -> DataFrame:
    """Entries with their feed's value where they have none of their own."""
    parent = feeds.select(F.col(key), *[F.col(c).alias(f"feed_{c}") for c in columns])
    joined = entries.join(parent, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"feed_{c}")).alias(c) if c in columns else F.col(c) for c in entries.columns])


def inherit_flag(entries: DataFrame, feeds: DataFrame, column: str, key: str = "feed_key") -> DataFrame:
    """Entries whose flag is their own or their feed's."""
    joined = entries.join(feeds.select(key, F.col(column).alias("feed_flag")), key, "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.lit(False)) | F.coalesce("feed_flag", F.lit(False))).drop("feed_flag")


def append_entries(entries: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables' entries; columns of other names or types raise TypeError."""
    kinds = lambda df: {f.name: f.dataType for f in df.schema}
    if kinds(entries) != kinds(more):
        raise TypeError("these aren't entries of the same columns")
    return entries.unionByName(more)


def by_title(feeds: DataFrame) -> DataFrame:
    """Feeds in order of their title; one without a title counts as empty."""
    return feeds.orderBy(F.coalesce("title", F.lit("")))


def title_ranks(feeds: DataFrame, key: str) -> DataFrame:
    """Feeds with their ``rank`` in the order of ``by_title``; equal titles in the order of their key."""
    one = feeds.withColumn("all_feeds", F.lit(0))
    return places(one, "all_feeds", [F.coalesce("title", F.lit("")), F.col(key)], "rank").drop("all_feeds")


def orphans(entries: DataFrame, feeds: DataFrame, key: str = "feed_key") -> DataFrame:
    return entries.join(feeds.select(key), key, "left_anti")


def many_parents(entries: DataFrame, feeds: DataFrame, key: str = "feed_key") -> DataFrame:
    """Entries' keys that more than one feed claims."""
    twice = feeds.groupBy(key).agg(F.count("*").alias("parents")).filter("parents > 1")
    return twice.join(entries.select(key).distinct(), key, "left_semi")


def estimate_times(entries: DataFrame, as_of: Column, key: str = "feed_key", time: str = "time", pos: str = "doc_pos") -> DataFrame:
    """A missing time is the next entry's plus a second, else the one before less a second, else ``as_of``.

    Entries are sorted over range partitions, so a feed isn't one task.
    """
    near = with_neighbours(entries, key, [F.col(pos)], time, "__earlier", "__later")
    return _estimated(near, as_of, time, F.col("__later"), F.col("__earlier")).drop("__earlier", "__later")


def estimate_in_documents(entries: DataFrame, as_of: Column, key: str = "feed_key", time: str = "time", pos: str = "doc_pos") -> DataFrame:
    """``estimate_times`` where a feed is one document: a window a document, which one row held a moment ago."""
    w = Window.partitionBy(key).orderBy(pos)
    return _estimated(entries, as_of, time, F.lead(time).over(w), F.lag(time).over(w))


def _estimated(rows: DataFrame, as_of: Column, time: str, later: Column, earlier: Column) -> DataFrame:
    second = F.expr("interval 1 second")
    return rows.withColumn(time, F.coalesce(F.col(time), later + second, earlier - second, as_of))


def order_key(by: str | None) -> list[Column]:
    """Newest first by time, ascending by another property, or the document's order."""
    if by is None:
        return [F.col("doc_pos")]
    if by not in SORTABLE:
        raise ValueError(f"entries can't be sorted by {by!r}")
    return [F.coalesce("time", F.timestamp_seconds(F.lit(0))).desc(), F.col("doc_pos")] if by == "time" else [F.col(by), F.col("doc_pos")]


def ranked(entries: DataFrame, by: str | None = "time", key: str = "feed_key") -> DataFrame:
    """Entries with their place in their feed, from 1; a feed isn't one task."""
    return places(entries, key, order_key(by), "rank")


def merge_feeds(entries: DataFrame, feeds: DataFrame, key: str = "feed_key") -> DataFrame:
    """One planet feed: titles get their feed's title in front."""
    titled = entries.join(feeds.select(key, F.col("title").alias("feed_title")), key)
    return titled.withColumn("title", F.concat_ws(": ", "feed_title", "title")).drop("feed_title")


def latest(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; partially aggregated before its shuffle.

    Maps have no order, so they travel as sorted entries.
    """
    maps = {f.name for f in rows.schema if isinstance(f.dataType, MapType)}
    row = F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in rows.columns])
    first = rows.select(*key, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)], row.alias("row")).alias("x"))
    best = first.groupBy(*key).agg(F.min("x").alias("x"))
    return best.select(*[(F.map_from_entries(F.col("x.row")[c]) if c in maps else F.col("x.row")[c]).alias(c) for c in rows.columns])


def newest_first(time: str = "last_retrieved") -> Column:
    """A key for ``latest``; rows without a time come last."""
    return F.coalesce(-F.unix_timestamp(time), F.lit(2**62))


def expired(rows: DataFrame, as_of: Column, floor: int = 1800) -> DataFrame:
    age = F.unix_timestamp(as_of) - F.unix_timestamp("last_retrieved")
    return rows.withColumn("expired", F.coalesce(age > F.greatest("time_to_live", F.lit(floor)), F.lit(True)))


def upsert(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after saving ``fresh``: blank data, files and HTML pages aren't saved."""
    worth = fresh.filter((F.btrim(F.col("feed_data"), F.lit(" \t\r\n")) != "") & ~F.col("href").startswith("file:") & ~F.lower("feed_data").rlike(r"(?s)^\s*(?:<!doctype html|<html)"))
    return latest(cached.unionByName(worth), ["href"], [newest_first(), F.col("title")])
