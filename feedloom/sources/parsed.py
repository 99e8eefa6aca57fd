"""A cache of parsed feeds: only documents that changed are shredded again.

Entries are kept by address in buckets; a bucket is a folder of Parquet files
that is never changed.  An update compares the digest of each document with
the one that the cache holds, parses the others, and writes new folders for the
buckets of those only.  A manifest names the folder of each bucket; writing it
is what makes an update happen, so readers see all of it or nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from feedloom.config import DEFAULTS, Settings

from .feeds import entries
from .fetch import FeedCache
from .tables import kept


@dataclass
class Updated:
    """What an update did: documents that came, that were parsed, and buckets written."""

    documents: int
    parsed: int
    buckets: int


class ParsedCache:
    """Entries of documents ``(href, xml)`` under a path, with the columns that are given.

    An empty or null document has no entries but is remembered; null addresses are left out.  Of rows that repeat an
    address the one with the largest text counts.  Two updates at a time: the second one to end raises, and is repeated.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], buckets: int = 64, settings: Settings = DEFAULTS):
        self.spark, self.path, self.columns, self.buckets, self.settings = spark, path.rstrip("/"), columns, buckets, settings

    # -- folders

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _manifests(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/manifests")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _folders(self) -> tuple[int, dict[int, str]]:
        """The manifest's number and the folder of each bucket: as many rows as buckets."""
        found = self._manifests()
        if not found:
            return 0, {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifests/{found[-1]}").collect()
        return found[-1], {r["bucket"]: r["folder"] for r in rows}

    def _schema(self) -> StructType:
        """Of the entries' rows: the address, the document's digest and the columns."""
        docs = self.spark.createDataFrame([], "feed_key string, xml string")
        own = entries(docs, columns=self.columns, settings=self.settings).schema
        return StructType([StructField("href", StringType()), StructField("digest", StringType()), StructField("bucket", IntegerType()), StructField("entry", own)])

    def _read(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/{folders[b]}/bucket={b}" for b in sorted(folders)]
        return self.spark.read.schema(self._schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())

    # -- use

    def entries(self, href: str | None = None) -> DataFrame:
        """The entries of all documents, or of one, whose bucket alone is read: href and the columns."""
        _, folders = self._folders()
        if href is not None:
            bucket = self.spark.range(1).select(self._bucket(F.lit(href))).first()[0]
            folders = {b: f for b, f in folders.items() if b == bucket}
        rows = self._read(folders).filter("entry IS NOT NULL")
        rows = rows if href is None else rows.filter(F.col("href") == href)
        return rows.select("href", "entry.*")

    def documents(self) -> DataFrame:
        """The documents that the cache knows: href, digest."""
        return self._read(self._folders()[1]).select("href", "digest").distinct()

    def update(self, docs: DataFrame, xml: str = "xml", key: str = "href") -> Updated:
        """Bring the cache up to these documents; others that it holds stay."""
        number, folders = self._folders()
        given = docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("href")).agg(F.max(F.coalesce(F.col(xml), F.lit(""))).alias("xml"))
        given = given.withColumn("digest", F.sha2("xml", 256))
        known = self._read(folders).select("href", "digest").distinct()
        changed = kept(given.join(known, ["href", "digest"], "left_anti").withColumn("bucket", self._bucket(F.col("href"))), "changed")
        documents, parsed = given.count(), changed.count()
        touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # as many as buckets
        if touched:
            own = entries(changed.select(F.col("href").alias("feed_key"), "xml"), columns=[*dict.fromkeys(["feed_key", *self.columns])], settings=self.settings)
            fresh = own.select(F.col("feed_key").alias("href"), F.struct(*self.columns).alias("entry"))
            fresh = changed.select("href", "digest", "bucket").join(fresh, "href", "left")
            self._replace(number, folders, touched, fresh, changed.select("href"))
        return Updated(documents, parsed, len(touched))

    def forget(self, hrefs: DataFrame) -> None:
        """Drop documents by address."""
        number, folders = self._folders()
        gone = kept(hrefs.select("href").distinct(), "forgotten")
        touched = [r["b"] for r in gone.select(self._bucket(F.col("href")).alias("b")).distinct().collect() if r["b"] in folders]
        if touched:
            self._replace(number, folders, touched, self.spark.createDataFrame([], self._schema()), gone)

    def _bucket(self, href: Column) -> Column:
        return F.pmod(F.xxhash64(href), F.lit(self.buckets)).cast("int").alias("bucket")

    def _replace(self, number: int, folders: dict[int, str], touched: list[int], fresh: DataFrame, gone: DataFrame) -> None:
        stay = self._read({b: folders[b] for b in touched if b in folders}).join(gone, "href", "left_anti")
        folder = f"rows-{uuid.uuid4().hex}"
        names = ["href", "digest", "entry"]
        rows = stay.withColumn("bucket", self._bucket(F.col("href"))).select(*names, "bucket").unionByName(fresh.select(*names, "bucket"))
        rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, path = self._fs()
        now = {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in touched if fs.exists(path(f"{self.path}/{folder}/bucket={b}"))}
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(list(now.items()), "bucket int, folder string").coalesce(1).write.parquet(draft)
        fs.mkdirs(path(f"{self.path}/manifests"))
        if self._manifests()[-1:] not in ([], [number]) or not fs.rename(path(draft), path(f"{self.path}/manifests/{number + 1}")):
            fs.delete(path(f"{self.path}/{folder}"), True)
            raise RuntimeError("another update came first; repeat this one")
        for old in self._manifests()[:-2]:  # readers may still use the one before
            self._drop_manifest(old)

    def _drop_manifest(self, number: int) -> None:
        fs, path = self._fs()
        used = set(self._folders()[1].values())
        after = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifests/{number + 1}").collect()
        used |= {r["folder"] for r in after}
        for r in self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifests/{number}").collect():
            if r["folder"] not in used:
                fs.delete(path(f"{self.path}/{r['folder']}"), True)
        fs.delete(path(f"{self.path}/manifests/{number}"), True)


def open_cache(spark: SparkSession, settings: Settings = DEFAULTS) -> FeedCache:
    """The cache of answers that the setting ``feed_cache`` names: a path, or a name below the session's warehouse."""
    name = settings.feed_cache
    if not name:
        raise ValueError("the setting feed_cache names no cache")
    inside = "/" not in name
    return FeedCache(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}" if inside else name)
