"""Folding the enclosures of an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_by_url(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Enclosures of two kinds of elements, matched by URL; the second's values win."""
    a, b = first.alias("a"), second.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    rest = [c for c in first.columns if c not in key]
    return a.join(b, on, "full").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key], *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in rest])


def group_defaults(members: DataFrame, key: list[str]) -> DataFrame:
    """One row per media group: its default (else first) member and all versions."""
    best = F.min_by(F.struct("url", "type", "file_size"), F.struct((~F.coalesce(F.col("is_default"), F.lit(False))).alias("d"), "pos")).alias("best")
    rows = members.groupBy(*key).agg(best, F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("versions"))
    return rows.select(*key, "best.*", "versions")


def inherit_group(members: DataFrame, groups: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    parent = groups.select(*key, *[F.col(c).alias(f"group_{c}") for c in columns])
    joined = members.join(parent, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"group_{c}")).alias(c) if c in columns else F.col(c) for c in members.columns])


def clean(rows: DataFrame) -> DataFrame:
    """Zeros and blanks are missing; the expression is full unless sample or nonstop."""
    number = [c for c in ("file_size", "duration", "height", "width", "bitrate") if c in rows.columns]
    out = rows.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in number})
    return out.withColumn("expression", F.when(F.col("expression").isin("sample", "nonstop"), F.col("expression")).otherwise("full"))


def itunes_path(category: Column, sub: Column) -> Column:
    return F.concat_ws("/", F.lit("Podcasts"), category, sub)


def with_size(candidates: Column) -> Column:
    """The writer's choice: the first version with a size, else the first."""
    return F.coalesce(F.get(F.filter(candidates, lambda x: x["file_size"] > 0), F.lit(0)), F.get(candidates, F.lit(0)))
