"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Paths of intermediate tables, in the order of writing.
_stored: list[str] = []
# Catalog names of those that lie in buckets, by path.
_named: dict[str, str] = {}

# Runtime re-planning settings every job relies on: partition coalescing for small
# inputs and splitting of skewed join partitions for hot keys.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Rows that one task sorts or groups, on average, where tasks are dealt by :func:`tasks_for`.
TASK_ROWS = 250_000
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "docketry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only for a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at a file-backed table, so a lost executor costs one re-read, and
    later passes prune columns and push filters into the Parquet scan.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with brief_shuffles(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, label: str, *keys: str, dealt: bool = False) -> DataFrame:
    """As :func:`materialise`, in buckets by ``keys``: joins on exactly these move only the other side, however often they run.

    ``dealt``: rows lie in ``bucket_count`` tasks by ``keys`` already and need not move again.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    name = f"bucketed_{uuid.uuid4().hex}"
    buckets = bucket_count(spark)
    with brief_shuffles(spark):
        (df if dealt else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    _named[path] = name
    return spark.table(name)


def bucket_count(spark: SparkSession) -> int:
    """With fewer buckets than tasks of a join, Spark would move both sides."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(rows: int, spark: SparkSession) -> int:
    """So many tasks that each holds a bounded number of ``rows``, whatever the size of the table."""
    return max(bucket_count(spark), -(-rows // TASK_ROWS))


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver next happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Tables dealt by some of the columns of a join are joined where they lie, if stored inside."""
    before = spark.conf.get(CO_PARTITION, "true")
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by :func:`release`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the intermediate tables written so far but for the first ``keep``; results that read them must have been used.

    Call ``mark()`` before a job and ``release(spark, mark)`` once its result is written, to delete that job's tables only.
    """
    return discard(spark, written(keep))


def written(first: int = 0) -> list[str]:
    """Paths of the intermediate tables written since ``mark()`` gave ``first``."""
    return _stored[first:]


def discard(spark: SparkSession, paths: list[str]) -> int:
    """Delete the intermediate tables at ``paths``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = set(paths)
    _stored[:] = [path for path in _stored if path not in gone]
    for path in gone:
        if path in _named:
            spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def mark() -> int:
    """How many intermediate tables there are so far."""
    return len(_stored)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
