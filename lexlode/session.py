"""Session helpers: the shared folder for cut lineage and the spreading of small scans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster
    an unset folder is an error, as files written there could not be read back.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"lexlode-{spark.sparkContext.applicationId}")
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are deleted as each of them ends."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends at files that survive the loss of any executor, and the
    optimizer sees the true size of what was written. Shuffle files of the write are
    deleted with it, as nothing can read them again. ``codec`` replaces the session's compression.
    """
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear_cuts(spark: SparkSession) -> None:
    """Delete every table that ``cut`` made in this application."""
    _delete(spark, _own_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan with fewer splits than cores before costly per-row work.

    Large tables already have more splits than cores and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
