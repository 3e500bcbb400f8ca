"""Tables between the phases of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share, as the cluster names it; a local master without one gets a local folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{_local()}"
    own = f"{folder.rstrip('/')}/codeloom-{context.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_remove, spark, own)
    return own


_FOLDERS: set[str] = set()


@functools.cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="codeloom-")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a leftover costs disk, not results
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """While it lasts, shuffle files of a query go when the query ends; the session's own setting comes back after it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """df, written once as a table in the shared folder and read back: its lineage ends there, and so do its shuffle files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*parts) if parts else df.write
    with _tidy(spark):
        writer.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def bucketed(df: DataFrame, key: str, within: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """within(df), stored as by stored() in buckets by key: what is grouped by the key, or by it and more, is not shuffled again.

    There are as many buckets as a shuffle has partitions.  `within` may group by the key too.  The table is known to the
    catalogue only while it is written.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"codeloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with _tidy(spark):
        within(df.repartition(parts, key)).write.bucketBy(parts, key).sortBy(key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved; the files stay
    spark.sql(f"drop table {name}")
    out._codeloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; what is left goes with the application."""
    for df in tables:
        if path := getattr(df, "_codeloom_path", None):
            _remove(df.sparkSession, path)


#: A stored table whose files hold at most so many bytes is broadcast (an eighth to a twentieth of its size in memory).
BROADCAST_BYTES = 8 << 20


def size(df: DataFrame) -> int:
    """Bytes of the files of a stored table."""
    jvm, path = df.sparkSession.sparkContext._jvm, df._codeloom_path
    at = jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


#: A task reads about so many bytes of shuffle files, and what is shuffled is dealt into one part for so many bytes of the tables it comes from.
TASK_BYTES, PART_BYTES = 8 << 20, 4 << 20
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bounded_tasks(spark: SparkSession, *paths: str) -> None:
    """For tables of more bytes than the session's number of shuffle partitions is made for, more and smaller ones.

    Adaptive execution joins small partitions, but cannot split those of an
    aggregate: with a fixed number of them, or large ones, what a task holds in memory grows
    with the tables.  The session keeps what it sets itself if that is finer.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    parts = -(-sum(int(p.getFileSystem(hadoop).getContentSummary(p).getLength()) for p in at) // PART_BYTES)
    first, each = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if parts <= int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        return
    spark.conf.set(first, str(parts))
    said = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(each, "64m").lower())
    if not said or int(said[1]) * _UNITS[said[2]] > TASK_BYTES:
        spark.conf.set(each, str(TASK_BYTES))


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df with a hint to broadcast it if the stored table that it is, or is taken `of`, is small; else the join is shuffled."""
    return F.broadcast(df) if size(df if of is None else of) <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that its joins are shuffled: files of ids are many times smaller than their rows, which a broadcast would bring to the driver."""
    return df.hint("merge")
