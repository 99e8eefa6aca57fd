"""Input tables and the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Where the setting is absent, one machine (a ``local`` master) gets a
    temporary folder; a cluster raises, as its executors share no such folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="feedloom-")
        root = f"{base.rstrip('/')}/feedloom-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder once and read back."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_partitions(df: DataFrame, each: int = 128 << 20) -> int:
    """Partitions of about ``each`` bytes by the planner's estimate, at least the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(size // each, 1_000_000)) if size < 1 << 60 else least
