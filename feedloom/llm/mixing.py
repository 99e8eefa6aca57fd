"""Mixing sources to target weights with hash-threshold histograms.

Every source has a target number of words.  Its documents are all taken
``floor(target / source size)`` times; what is left of the target is filled by
one more copy of those documents whose hash lies below the source's threshold.
A threshold is found from histograms only: words are summed by source and hash
bucket, the bucket in which the budget runs out is the boundary, and the next
level looks at nothing but the boundary bucket, with finer buckets.  Nothing is
sorted but the histogram.  Where a long document leaves a gap at the boundary,
a further pass with another hash fills it from documents that fit into the gap.

Driver memory holds a few numbers per source, never per document.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; sources of size 0 take nothing.  A null id is hashed like any
other.  Rows that repeat id and text share one hash and go together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

BITS = 12
LEVELS = 3


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Share ``share`` times all sizes by weight, none above ``cap`` times its own."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, active = share * sum(sizes.values()), {}, list(order)
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in active}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        active = [s for s in active if s not in out]
    return {s: float(out[s]) for s in order}


def _with_source(big: DataFrame, rows: list[tuple], schema: str, source: str = "source", limit: int = 100_000) -> DataFrame:
    """``big`` joined with the row of its source, ``rows`` being ordered from the largest source down.

    The ``limit`` largest sources are broadcast; the others are joined by source, and none of them holds more than
    1/``limit`` of the words.
    """
    spark = big.sparkSession
    on = lambda df: F.col(source).eqNullSafe(df["b_source"])
    hot = spark.createDataFrame(rows[:limit], schema)
    if len(rows) <= limit:
        return big.join(F.broadcast(hot), on(hot))
    rest = spark.createDataFrame(rows[limit:], schema)
    cold = big.join(F.broadcast(hot.select("b_source")), on(hot), "left_anti").join(rest, on(rest))
    return big.join(F.broadcast(hot), on(hot)).unionByName(cold)


def _thresholds(sized: DataFrame, budget: dict, salt: int, taken: list[dict]) -> dict:
    """For each source the largest threshold on this pass's hash within its budget."""
    state = {s: (0, 0) for s in budget}  # the boundary's prefix, words below it
    for level in range(LEVELS):
        rows = [(s, b, *state[s], cuts_of(taken, s)) for s, b in budget.items()]
        h = pass_hash(salt)
        here = _with_source(sized, rows, f"b_source string, budget long, prefix long, below long, {CUTS}").filter(~taken_before(salt))
        if salt:
            here = here.filter(F.col("size") <= F.col("budget"))
        if level:
            here = here.filter(F.shiftrightunsigned(h, 64 - BITS * level) == F.col("prefix"))
        hist = here.groupBy("b_source", "budget", "below", F.shiftrightunsigned(h, 64 - BITS * (level + 1)).alias("bucket")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("b_source").orderBy("bucket")
        cum = hist.withColumn("upto", F.col("below") + F.sum("words").over(w))
        edge = cum.groupBy("b_source").agg(
            F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("below")))).alias("edge"),
            F.max("upto").alias("all"),
        )
        found = {r["b_source"]: r for r in edge.collect()}
        for s in list(state):
            r = found.get(s)
            if r is not None and r["edge"] is not None:
                state[s] = (r["edge"]["bucket"], r["edge"]["below"])
            else:  # all that is left fits: the threshold is this level's end
                shift = BITS if level else 0
                prefix = (state[s][0] + 1) << shift if level else 1 << BITS
                state[s] = (prefix, r["all"] if r is not None else state[s][1])
    return state


def pass_hash(salt: int):
    return F.col("hash") if salt == 0 else F.xxhash64("hash", F.lit(salt))


CUTS = "cuts array<struct<t: long, b: long>>"


def cuts_of(taken: list[dict], source) -> list[tuple[int, int]]:
    """The (threshold, budget) of each pass so far; (0, 0) takes nothing."""
    return [limits.get(source, (0, 0)) for limits in taken]


def taken_before(passes: int):
    """Whether an earlier pass took the row, from the joined column ``cuts``."""
    out = F.lit(False)
    for salt in range(passes):
        cut = F.col("cuts")[salt]
        below = F.shiftrightunsigned(pass_hash(salt), 64 - BITS * LEVELS) < cut["t"]
        out = out | (below if salt == 0 else below & (F.col("size") <= cut["b"]))
    return out


def _sized(id_col: str, text_col: str, source_col: str) -> list:
    """The columns that decide, from a document's own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(id_col), text).alias("hash")]


def _plan(sized: DataFrame, weights, share: float, cap: float, passes: int) -> tuple[list[tuple], int]:
    """(source, size, target, base, cuts) of each source, the largest first, and the number of passes."""
    sizes = {r["source"]: r["n"] or 0 for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights, share, cap)
    base = {s: min(int(goal[s] // n), int(cap)) if n else 0 for s, n in sizes.items()}
    gap = {s: math.floor(goal[s]) - base[s] * n for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (-sizes[s], s is None, s))
    taken: list[dict] = []
    for salt in range(passes):
        budget = {s: gap[s] for s in order if gap[s] > 0 and (salt == 0 or gap[s] > 0.0005 * goal[s])}
        if not budget:
            break
        found = _thresholds(sized, budget, salt, taken)
        taken.append({s: (t, budget[s]) for s, (t, _) in found.items()})
        gap = {s: gap[s] - found[s][1] if s in found else gap[s] for s in gap}
    return [(s, sizes[s], goal[s], base[s], cuts_of(taken, s)) for s in order], len(taken)


PLANNED = f"b_source string, source_size long, target double, base int, {CUTS}"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, passes: int = 3) -> DataFrame:
    """One row per document: id, source, size, source_size, target, repeats, taken, hash."""
    sized = staged(docs.select(F.col(id_col).alias("id"), *_sized(id_col, text_col, source_col)), "sized")
    plan, passes = _plan(sized, weights, share, cap, passes)
    out = _with_source(sized, plan, PLANNED).withColumn("repeats", F.col("base") + taken_before(passes).cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, passes: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: a filter by thresholds, so no text is shuffled."""
    plan, passes = _plan(staged(docs.select(*_sized(id_col, text_col, source_col)), "sized"), weights, share, cap, passes)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_sized(id_col, text_col, source_col))
    met = _with_source(rows, plan, PLANNED).withColumn("repeats", F.col("base") + taken_before(passes).cast("int")).filter("repeats > 0")
    return met.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")
