"""Shared plumbing of the training-data operators.

Tables cut from their lineage are written as Parquet to the folder that the
cluster names in ``spark.checkpoint.dir``; every executor and the driver see
it, so a lost executor costs only the tasks that it was running.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.sources.tables import shared_root, table

__all__ = ["shared_root", "table"]

#: The white space of the contracts: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def staged(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in one folder a value of ``by``, and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._feedloom_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_feedloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target.getFileSystem(conf).delete(target, True)


def tidy(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives its memory back at its task's end: workers outlive tasks and stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if forget is not None:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)
    return F.when(plain, F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``'s."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def small_lookup(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast where its counted rows prove it small."""
    return F.broadcast(df) if rows <= limit else df


def input_partitions(df: DataFrame, each: int = 128 << 20) -> int:
    """Partitions of about ``each`` bytes by the planner's estimate of the input, at least the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(size // each, 1_000_000)) if size < 1 << 60 else least  # larger: unknown


#: A block of a filter holds 2**15 bits; a key sets four of one block.
BLOCK_BITS, KEY_BITS, PROBES = 15, 16, 4


def _place(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(11)), F.lit(blocks)).cast("int")


def _bit(h: Column, probe: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(h, F.lit(12)), BLOCK_BITS * probe).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


#: So many blocks (16 MB) may be broadcast.
BROADCAST_BLOCKS = 4096


def key_filter(keys: DataFrame, key: str, n: int, most: int | None = BROADCAST_BLOCKS) -> DataFrame:
    """A Bloom filter of the column ``key`` as blocks ``(block, bits)``, with 16 bits a key.

    It has ``most`` blocks at most, so that it may be broadcast: with more keys than those serve, it lets more pass but never
    stops a key that it holds.  Without ``most`` it grows with the keys, and a large one is met by a join on the block.
    """
    blocks = max(1, (n * KEY_BITS >> BLOCK_BITS) + 1)
    blocks = blocks if most is None else min(most, blocks)
    bits = F.explode(F.array(*[_bit(F.col(key), p) for p in range(PROBES)]))
    rows = keys.select(_place(F.col(key), blocks).alias("block"), bits.alias("bit"))
    out = staged(rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")
    out._feedloom_blocks = blocks
    return out


def might_hold(df: DataFrame, key_blocks: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with a column that is false only where the filter holds no such key."""
    blocks = key_blocks._feedloom_blocks
    known = key_blocks.select(F.col("block").alias(f"{name}_block"), F.col("bits").alias(f"{name}_bits"))
    known = F.broadcast(known) if blocks <= BROADCAST_BLOCKS else known  # keys are dealt evenly to blocks

    def is_set(probe: int) -> Column:
        bit = _bit(key, probe).cast("int")
        byte = F.conv(F.hex(F.substr(F.col(f"{name}_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1

    every = is_set(0)
    for p in range(1, PROBES):
        every = every & is_set(p)
    joined = df.join(known, _place(key, blocks) == F.col(f"{name}_block"), "left")
    return joined.withColumn(name, F.coalesce(every, F.lit(False))).drop(f"{name}_block", f"{name}_bits")


def frequent(total: int, least: int = 10_000, share: int = 1000) -> int:
    """The number of rows above which a key is frequent; fewer than ``share`` keys are."""
    return max(least, total // share)


def join_counted(big: DataFrame, small: DataFrame, on: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, whose column ``rows`` tells how many of the ``total`` rows of ``big`` have the key.

    Frequent keys (fewer than a thousand) are met by broadcast, so no task gets all rows of one.
    """
    often = F.col(rows) > frequent(total)
    hot = F.broadcast(small.filter(often))
    cold = big.join(F.broadcast(small.filter(often).select(*on)), on, "left_anti")
    return big.join(hot, on).unionByName(cold.join(small.filter(~often), on, how))


#: Characters that are never text by themselves: they enclose the matches of a pattern, and escape themselves.
OPEN, CLOSE, ESCAPE = "﷐", "﷑", "﷒"


def escaped(text: Column) -> Column:
    """``text`` without the enclosing characters; ``unescaped`` restores them."""
    t = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2"))
    t = F.replace(F.replace(t, F.lit(OPEN), F.lit(ESCAPE + "0")), F.lit(CLOSE), F.lit(ESCAPE + "1"))
    return F.when(text.rlike(f"[{OPEN}{CLOSE}{ESCAPE}]"), t).otherwise(text)


def unescaped(text: Column) -> Column:
    t = F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(CLOSE)), F.lit(ESCAPE + "0"), F.lit(OPEN))
    return F.when(text.contains(ESCAPE), F.replace(t, F.lit(ESCAPE + "2"), F.lit(ESCAPE))).otherwise(text)


def enclosed(text: Column, pattern: str) -> Column:
    """``text`` with every match of the pattern enclosed, in one pass."""
    return F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE)


def running_sums(values: Column, block: int = 256) -> Column:
    """Before each element of an array, the sum of those before it, in about n * ``block`` / 2 steps."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    once = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))
    floor = lambda i: F.floor(i / block).cast("int")

    def starts(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), floor(F.size(vs) - 1)), lambda b: total(F.slice(vs, b * block + 1, F.lit(block))))
        at = once(blocks, lambda bs: F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b))))
        return once(at, lambda bs: F.transform(vs, lambda _, i: F.get(bs, floor(i)) + total(F.slice(vs, floor(i) * block + 1, F.pmod(i, F.lit(block))))))

    return once(values, starts)
