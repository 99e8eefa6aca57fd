"""Embedding near-duplicates with spherical-cap filters.

Filter directions are random product codes: the space, turned at random, is
split into two blocks, each with its own Gaussian codewords, and a direction is
a pair of codewords.  ``codes`` independent codes make misses independent.  A vector passes every direction on which its projection exceeds a
threshold; those are *list-decoded* from the two short lists of block scores,
without looking at all directions.  Vectors meet where they pass the same
filter, and every meeting is verified by the cosine in double precision.

A task gets each vector with the filters before its own, so a link is counted in
the first filter that its ends share.  Vectors keep their precision.

Equal vectors are one class first.  The threshold follows the number of
classes, so that a filter holds about ``per_filter`` random vectors, and the
number of codewords follows from the wish that a pair at exactly the limit
shares ``want`` filters on average: the chance to miss it is near exp(-want).
A filter with many vectors (a dense cluster) is split into blocks, and each pair
of blocks is a task of its own.  Tasks return no pairs: they return each
vector's number of links and a spanning star for each component they see.

Defined results: vectors that are null, empty, zero or have null or non-finite
components link with nothing; vectors of different lengths never link; rows
with a null id link with nothing and have a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import join_counted, staged, table
from .near_dedup import components

NORMAL = NormalDist()


def shared_fraction(t: float, cosine: float) -> float:
    """P(second projection > t | first > t) for unit vectors at that cosine."""
    z = np.linspace(t, t + 8, 4001)
    weight = np.exp(-z * z / 2)
    rest = np.array([1 - NORMAL.cdf((t - cosine * x) / math.sqrt(1 - cosine * cosine)) for x in z])
    return float((weight * rest).sum() / weight.sum())


def plan(n: int, cosine: float, want: float, per_filter: int, codes: int) -> tuple[float, int]:
    """The threshold and the number of codewords of each block of each code, for n vectors."""
    p = min(0.004, per_filter / max(n, 1))
    t = NORMAL.inv_cdf(1 - p)
    return t, math.ceil(math.sqrt(want / codes / (p * shared_fraction(t, cosine))))


def decode(x: np.ndarray, t: float, words: int, codes: int, seed: int = 11) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of the filters that it passes."""
    d = x.shape[1]
    half = d // 2
    out: list[list[np.ndarray]] = [[] for _ in x]
    for code in range(codes):
        rng = np.random.default_rng((seed, d, words, code))
        y = x @ np.linalg.qr(rng.standard_normal((d, d)))[0]
        one = y[:, :half] @ rng.standard_normal((half, words)) if half else np.zeros((len(x), words))
        two = y[:, half:] @ rng.standard_normal((d - half, words))
        for a, b, found in zip(one, two, out, strict=True):
            order = np.argsort(b)
            take = words - np.searchsorted(b[order], t - a)  # how many second codewords suffice with each first one
            i = np.repeat(np.arange(words), take)
            nth = np.arange(len(i)) - np.repeat(np.cumsum(take) - take, take)
            found.append((code * words + i) * words + order[words - 1 - nth])
    return [np.sort(np.concatenate(f)) for f in out]


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(t: float, words: int, codes: int, number: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            by_length: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(k)
            for d, all_of in by_length.items():
                for at in range(0, len(all_of), 1000):
                    some = all_of[at : at + 1000]
                    found = decode(unit([vectors[k] for k in some]), t, words, codes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[k] for k in some], pa.int64()), pa.array([d] * len(some), pa.int32()), pa.array([copies[k] for k in some], pa.int64()), pa.array([vectors[k] for k in some], pa.list_(number)), pa.array(found, pa.list_(pa.int64()))],
                        names=["id", "d", "copies", "vector", "filters"],
                    )

    return run


def _linked(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        sides = [rows[rows["side"] == s].reset_index(drop=True) for s in (0, 1)]
        a, b = sides[0], sides[1] if len(sides[1]) else sides[0]
        same = not len(sides[1])
        close = unit(a["vector"].tolist()) @ unit(b["vector"].tolist()).T >= cosine
        if same:
            np.fill_diagonal(close, False)
        if not close.any():
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        # Only what an earlier filter doesn't hold as well counts here.
        pick_a, pick_b = close.any(axis=1), close.any(axis=0)
        early = [x.tolist() for x in (*a["earlier"][pick_a], *b["earlier"][pick_b])]
        names = {f: k for k, f in enumerate(sorted({f for x in early for f in x}))}
        member = np.zeros((len(early), len(names)), np.float32)
        for k, x in enumerate(early):
            member[k, [names[f] for f in x]] = 1
        close = close[np.ix_(pick_a, pick_b)]
        na = int(pick_a.sum())
        close &= member[:na] @ member[na:].T == 0
        a, b = a[pick_a].reset_index(drop=True), b[pick_b].reset_index(drop=True)
        ids = np.concatenate([a["id"], b["id"]])
        counts = np.concatenate([close @ b["copies"].to_numpy(), np.zeros(len(b), np.int64) if same else close.T @ a["copies"].to_numpy()])
        root = ids.copy()
        while True:  # the least id reachable within this task
            low = np.where(close, root[na:][None, :], np.iinfo(np.int64).max).min(axis=1)
            new_a = np.minimum(root[:na], low)
            high = np.where(close, new_a[:, None], np.iinfo(np.int64).max).min(axis=0)
            new = np.concatenate([new_a, np.minimum(root[na:], high)])
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"id": ids, "links": counts, "root": root})

    return run


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, want: float = 12.0, per_filter: int = 256, codes: int = 6, block: int = 1024) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    v = F.col("vector")
    double = isinstance(vectors.schema[vec_col].dataType.elementType, DoubleType)
    kind, number = ("array<double>", pa.float64()) if double else ("array<float>", pa.float32())
    fine = F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vector"))
    good = rows.filter(fine)
    classes = staged(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    t, words = plan(n, cosine, want, per_filter, codes)
    found = classes.select("rep", "vector", "copies").mapInArrow(_filters(t, words, codes, number), f"id long, d int, copies long, vector {kind}, filters array<bigint>")
    found = staged(found, "filters")
    entries = found.withColumn("filter", F.explode("filters"))
    sizes = entries.groupBy("d", "filter").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = staged(sizes.select("d", "filter", "size", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "sizes")
    all_of = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = join_counted(entries, sizes, ["d", "filter"], "size", all_of)  # no task gets all vectors of a dense filter
    dealt = met.withColumn("earlier", F.filter("filters", lambda x: x < F.col("filter"))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).withColumn("side", (F.col("own") != F.col("lo")).cast("int"))
    seen = dealt.select("d", "filter", "lo", "hi", "side", "id", "copies", "vector", "earlier").groupBy("d", "filter", "lo", "hi").applyInPandas(_linked(cosine), "id long, links long, root long")
    seen = staged(seen, "links")
    counts = seen.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = seen.select("id").distinct()
    comps = components(nodes, seen.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, classes["rep"] == counts["id"], "left").drop("id").join(comps, F.col("rep") == F.col("id"), "left")
    known = staged(known.select("vector", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("comp", "rep").alias("comp")), "known")
    met = join_counted(good, known, ["vector"], "copies", total).select("id", "n", "comp")
    alone = rows.filter(~fine).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("comp"))
    return met.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("comp") == F.col("id"), F.lit(True)).alias("kept"))


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(table(spark, sf_dir, "embeddings"))
