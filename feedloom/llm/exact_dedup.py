"""Exact deduplication with a log-structured merge index (native operators only).

One pass reads the texts and writes a log of ``(id, digest)``.  The log is dealt
to *memtables*; each is aggregated and flushed as a *run* of level 0: rows
``(digest, lo, hi, n)`` sorted by digest, with the smallest and the largest id
and the count.  Every run has a Bloom filter of 16 bits a key.  A new run's digests
probe the filters of the runs before it: a run whose filter stops them all isn't read, the
others are read for what passes, and only digests met in two runs, or twice in
one, are gathered.  *Compaction* merges the runs of a level into one of the next where the
level holds ``fanout`` of them, and forgets their filters.

The index may be kept for further batches: their documents are then held against
all before by digest (texts are compared within a batch), and no earlier text is read again.

The documents probe a filter of the repeated digests: what it stops is single
and takes part in no join.  The texts of the others are compared byte by byte:
a group is whole where its least and its largest text are equal, which is
aggregated before the shuffle, so a text with a million copies travels once a
task.  Texts that share a digest and differ are regrouped by their whole text,
so a digest collision loses nothing.  Very frequent digests are met by broadcast
(fewer than a thousand), the others by a join on the digest without texts.

Defined results: a null text counts as the empty text.  A null id is smaller
and never preferred to any other; a group of null ids only has a null
``keep_id`` and all its rows stay.  Rows that repeat an id and its text are one
document and all get the same verdict.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, key_filter, might_hold, scratch_name, staged, table, unstage

MEMTABLE_ROWS = 500_000_000


@dataclass
class Run:
    """A sorted table ``(digest, lo, hi, n)`` with its rows counted and its filter made when first needed."""

    table: DataFrame
    rows: int
    made: list[DataFrame] = field(default_factory=list)

    def filter(self) -> DataFrame:
        if not self.made:
            self.made.append(key_filter(self.table, "digest", self.rows, most=None))
        return self.made[0]

    def drop(self) -> None:
        unstage(self.table, *self.made)


class DigestIndex:
    """Levels of runs; ``lo`` and ``hi`` are the extreme ids of a digest, ``n`` its rows."""

    def __init__(self, spark: SparkSession, fanout: int = 8):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.read_runs = self.stopped_runs = 0
        self.met: list[DataFrame] = []  # digests found in two runs

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def add(self, digests: DataFrame, memtable: Column | None = None, memtables: int = 1) -> None:
        """Flush ``(digest, id)``, hold each new run against those before it, and compact full levels."""
        before, self.levels = self.levels, [[]]
        self.flush(digests, memtable, memtables)
        new, self.levels = self.levels[0], before
        for run in new:
            for older in self.runs():
                if (both := self._common(run.table, older)) is not None:
                    self.met.append(both)
            self.levels[0].append(run)
            self._settle()

    def _passing(self, digests: DataFrame, run: Run) -> DataFrame | None:
        """The digests that a run's filter lets pass; None where it stops all of them, and the run isn't read."""
        passing = staged(might_hold(digests.select("digest"), run.filter(), F.col("digest"), "hit").filter("hit").select("digest").distinct(), "passing")
        if passing.isEmpty():
            self.stopped_runs += 1
            unstage(passing)
            return None
        self.read_runs += 1
        return passing

    def _common(self, digests: DataFrame, run: Run) -> DataFrame | None:
        passing = self._passing(digests, run)
        if passing is None:
            return None
        both = staged(run.table.select("digest").join(passing, "digest", "left_semi"), "met")
        unstage(passing)
        return both

    def repeats(self) -> DataFrame:
        """(digest, lo, hi, n) of the digests with more than one row, over all runs."""
        runs = self.runs()
        if len(runs) == 1:
            return runs[0].table.filter("n > 1")
        many = reduce(DataFrame.unionByName, [run.table.filter("n > 1").select("digest") for run in runs] + self.met)
        many = staged(many.distinct(), "many")
        rows = reduce(DataFrame.unionByName, [run.table.join(many, "digest", "left_semi") for run in runs])
        return rows.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("n > 1")

    def _settle(self) -> None:
        """Merge the levels that are full."""
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                some, self.levels[at] = self.levels[at], []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._merged(some, at + 1))
            at += 1

    def flush(self, digests: DataFrame, memtable: Column | None = None, memtables: int = 1) -> None:
        """Flush ``(digest, id)`` as one sorted run a memtable, all in one job."""
        slot = F.lit(0) if memtable is None else F.pmod(memtable, F.lit(memtables))
        rows = digests.select(slot.cast("int").alias("memtable"), "digest", "id")
        runs = rows.groupBy("memtable", "digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        whole = staged(runs.sortWithinPartitions("memtable", "digest"), "run0", "memtable")
        sizes = {r["memtable"]: r["count"] for r in whole.groupBy("memtable").count().collect()}  # one row a memtable
        for k in sorted(sizes):
            part = self.spark.read.schema(runs.drop("memtable").schema).parquet(f"{whole._feedloom_path}/memtable={k}")
            part._feedloom_path = f"{whole._feedloom_path}/memtable={k}"
            self.levels[0].append(Run(part, sizes[k]))

    def compact(self) -> None:
        """Merge runs level by level until one is left."""
        at = 0
        while len(self.runs()) > 1:
            while self.levels[at]:
                some, self.levels[at] = self.levels[at][: self.fanout], self.levels[at][self.fanout :]
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(some[0] if len(some) == 1 else self._merged(some, at + 1))
            at += 1

    def _merged(self, some: list[Run], level: int) -> Run:
        rows = reduce(DataFrame.unionByName, [run.table for run in some])
        out = rows.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        out = staged(out.sortWithinPartitions("digest"), f"run{level}")
        made = Run(out, out.count())
        for run in some:
            run.drop()
        return made

    def probe(self, digests: DataFrame) -> DataFrame:
        """(digest, lo, hi, n) of those digests that the index holds; runs whose filter stops all of them aren't read."""
        found = [run.table.limit(0) for run in self.runs()[:1]]
        for run in self.runs():
            if (passing := self._passing(digests, run)) is not None:
                found.append(run.table.join(passing, "digest", "left_semi"))
        return reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memtable_rows: int = MEMTABLE_ROWS, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the identifier of a group that stays: ``min`` or ``max``.  With an ``index`` the batches that it holds
    count too, and this one is added to it.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    rows = with_digest(docs, id_col, text_col)
    log = staged(rows.select("id", "digest", F.spark_partition_id().alias("slice")), "log")
    n = log.count()
    index = DigestIndex(docs.sparkSession) if index is None else index
    index.add(log, F.col("slice"), max(2, -(-n // memtable_rows)))
    log = log.drop("slice")
    one = F.lit(1).cast("long")
    if not index.runs():
        return _verdict(log.select("id", "digest", F.col("id").alias("keep_id"), one.alias("group_size")), id_col)
    best = F.col("lo" if keep == "min" else "hi")
    repeats = staged(index.repeats().select("digest", best.alias("keep_id"), F.col("n").alias("group_size")), "repeats")
    blocks = key_filter(repeats, "digest", repeats.count())
    hits = might_hold(rows, blocks, F.col("digest"), "hit").filter("hit")
    texts = hits.groupBy("digest").agg(F.min("text").alias("first"), F.max("text").alias("last"))
    torn = staged(texts.filter("first <> last").select("digest"), "torn")
    grouped = _met(might_hold(log, blocks, F.col("digest"), "hit"), repeats, n)
    if not torn.isEmpty():
        members = rows.join(torn, "digest", "left_semi")
        checked = grouped.join(torn.withColumn("same", F.lit(False)), "digest", "left").withColumn("same", F.coalesce("same", F.lit(True)))
        grouped = regroup(members, checked, keep)
    return _verdict(grouped, id_col)


def _met(flagged: DataFrame, repeats: DataFrame, n: int) -> DataFrame:
    """(id, digest, keep_id, group_size) of rows with the column ``hit``, which only repeated digests have (and a few single ones)."""
    often = F.col("group_size") > max(10_000, n // 1000)  # fewer than a thousand digests
    hot = F.broadcast(repeats.filter(often).withColumn("met", F.lit(True)))
    first = flagged.join(hot, "digest", "left")
    done = first.filter(~F.col("hit") | F.col("met"))
    rest = first.filter(F.col("hit") & F.col("met").isNull()).select("id", "digest").join(repeats.filter(~often), "digest", "left")
    names = ["id", "digest", "keep_id", "group_size"]
    both = done.select(*names).unionByName(rest.select(*names))
    return both.select("id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


def _verdict(grouped: DataFrame, id_col: str) -> DataFrame:
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    return grouped.select(F.col("id").alias(id_col), "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def regroup(members: DataFrame, checked: DataFrame, keep: str) -> DataFrame:
    """Split the digests whose texts differ into groups of equal text."""
    mixed = staged(checked.filter("not same").select("digest").distinct(), "mixed")
    clean = checked.drop("same").join(mixed, "digest", "left_anti")
    torn = members.join(mixed, "digest", "left_semi").select("id", "digest", "text")
    best = (F.min if keep == "min" else F.max)("id").alias("keep_id")
    groups = torn.groupBy("digest", "text").agg(best, F.count("*").alias("group_size"))
    return clean.unionByName(torn.join(groups, ["digest", "text"]).select("id", "digest", "keep_id", "group_size"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows whose id passes the filter of the dropped ids are joined; the others stay where they are.
    """
    verdict = exact_dedup(docs, id_col, text_col, keep)
    gone = staged(verdict.filter("not kept").select(F.col(id_col).alias("__gone_id"), F.unhex("text_sha256").alias("__gone_digest")).distinct(), "gone")
    hit, digest = scratch_name(docs, "feedloom_hit"), scratch_name(docs, "feedloom_digest")
    flagged = might_hold(docs, key_filter(gone, "__gone_id", gone.count()), F.col(id_col), hit)
    some = flagged.filter(F.col(hit)).withColumn(digest, F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)))
    some = some.join(gone, (some[digest] == gone["__gone_digest"]) & some[id_col].eqNullSafe(gone["__gone_id"]), "left_anti")
    return flagged.filter(~F.col(hit)).select(*docs.columns).unionByName(some.select(*docs.columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
