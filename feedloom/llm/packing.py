"""Packing documents into sequences along a Hilbert curve.

A document becomes a vector of hashed token counts, which a fixed random
projection brings to three dimensions; the cell of that point has a place on
the Hilbert curve, and documents that follow each other along the curve are
packed next to each other.  The order is a range sort over (key, id); only
those small columns are sorted, and the ids of the tokens move once, to meet
their document's place.

Sequences are filled without gaps: documents are cut where a sequence ends.
What is left at the very end goes into sequences whose lengths are powers of
two, which need no padding either.

Defined results: a null text counts as empty and gives the end id alone.  Rows
that repeat an id are packed one by one.  An empty table gives no piece.  Ties
of the key are ordered by id (null first) and by the row's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_partitions, staged, table, tidy
from .tokens import MEMORY_BYTES, encoder, long_crc, tokenizer_path

DIMS, BITS, FEATURES = 3, 16, 256


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), after Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(docs: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as arrays of token ids."""
    directions = np.random.default_rng(20240229).standard_normal((FEATURES, DIMS))
    rows = np.zeros((len(docs), DIMS))
    for i, ids in enumerate(docs):
        if len(ids):
            counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=FEATURES)
            rows[i] = (counts / np.linalg.norm(counts)) @ directions
    cells = np.clip((rows + 4.0) / 8.0, 0, 1 - 2.0**-BITS) * (1 << BITS)
    return hilbert_keys(cells.astype(np.int64))


def _tokenised(path: str, end_id: int, memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, memory_bytes)
        end = np.array([end_id], code.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                raw = [x + end for x in code.encode(batch.column(1).slice(at, 256).to_pylist())]
                keys = curve_keys([np.frombuffer(x, code.dtype)[:-1] for x in raw])
                n = [len(x) // code.dtype.itemsize for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "curve", "n", "ids"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's start within its (sorted) partition."""
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(1).to_numpy()
        upto = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(upto - n, pa.int64()), pa.array(n, pa.int64())], names=["row", "part", "local", "n_again"])
        at = int(upto[-1]) if len(n) else at


def tail_lengths(rest: int) -> list[int]:
    """The powers of two that make up what is left after the full sequences."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(bases: dict[int, int], total: int, size: int, width: int):
    full = total // size
    tails = np.cumsum([0, *tail_lengths(total - full * size)]) + full * size

    def place(at: int) -> tuple[int, int, int]:
        """The sequence at a global position, its start and its end."""
        if at < full * size:
            s = at // size
            return s, s * size, (s + 1) * size
        k = int(np.searchsorted(tails, at, side="right")) - 1
        return full + k, int(tails[k]), int(tails[k + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("curve", pa.int64())]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc, curve, n, raw, part, local in zip(*(c.slice(at, 512).to_pylist() for c in batch.columns), strict=True):
                    ids, g, done = np.frombuffer(raw, f"<u{width}").astype("<u4"), bases[part] + local, 0
                    while done < n:
                        s, lo, hi = place(g + done)
                        take = min(n - done, hi - g - done)
                        rows.append((doc, done, take, long_crc(ids[done : done + take]), n, s, g + done - lo, curve))
                        done += take
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for _, k in kinds], names=[x for x, _ in kinds])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, tokenizer: str | None = None, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve.

    ``memory_bytes`` bounds what each worker remembers of pieces' ids.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    width = encoder(path).dtype.itemsize
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = input_partitions(rows)
    tokens = rows.mapInArrow(tidy(_tokenised(path, end_id, memory_bytes)), "doc_id long, curve long, n long, ids binary")
    tokens = staged(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    order = tokens.select("row", "n", "curve", "doc_id").repartitionByRange(parts, "curve", "doc_id", "row").sortWithinPartitions("curve", "doc_id", "row")
    starts = staged(order.select("row", "n").mapInArrow(_running, "row long, part int, local long, n_again long"), "starts")
    sums = sorted((r["part"], r["n"]) for r in starts.groupBy("part").agg(F.sum("n_again").alias("n")).collect())  # one row a partition
    bases, total = {}, 0
    for part, n in sums:
        bases[part] = total
        total += n
    # A row number is unique, so this join has no hot key.
    met = tokens.join(starts.select("row", "part", "local"), "row").select("doc_id", "curve", "n", "ids", "part", "local")
    return met.mapInArrow(tidy(_pieces(bases, total, size, width)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
