"""The engine's own tables on disk: idempotent appends and reads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.schemas import EVAL_METRIC, QUERY_LOG, struct
from lexlode.session import shuffles_deleted

CODEC = "zstd"  # repeated windows of a document take little room in its long matches


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at a path, of whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored table, or an empty one of its schema if nothing is stored there yet.

    Any other trouble (no permission, a folder that holds no table) is an error: taken for an empty
    table it would make every row look new.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], struct(ddl))
    return spark.read.schema(struct(ddl)).parquet(path)


def holds_any(path: str, ddl: str, ids: DataFrame) -> bool:
    """Whether a store has rows of any of the ids: a table of one column that the store has as well."""
    spark, (key,) = ids.sparkSession, ids.columns
    if not exists(spark, path):
        return False
    with shuffles_deleted(spark):
        return not read_table(spark, path, ddl).select(key).join(ids, key).isEmpty()


def append_new(rows: DataFrame, path: str, ddl: str, keys: list[str], by: list[str] | None = None, known_new: bool = False) -> int:
    """Append rows whose key is not stored yet, each key once; returns their number.

    The store is read once, for its keys; the rows are counted while they are written,
    in files of the advised size; ``by`` names columns that become folders. Rows that the caller
    knows to be new and distinct are written where they are made, without a shuffle.
    """
    fresh = rows if known_new else rows.dropDuplicates(keys).join(read_table(rows.sparkSession, path, ddl).select(*keys), keys, "left_anti")
    seen = Observation()
    out = fresh.select(*struct(ddl).fieldNames()).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = (out if known_new else out.hint("rebalance", *(by or []))).write.mode("append")
    with shuffles_deleted(rows.sparkSession):
        (writer.partitionBy(*by) if by else writer).parquet(path, compression=CODEC)
    return seen.get["n"]


def append_log(rows: DataFrame, path: str, ddl: str, key: list[str]) -> None:
    """Append log rows with an id hashed from their key columns, so that a repeated write can be told apart."""
    with_id = rows.withColumn("id", F.xxhash64(*key).bitwiseAND(F.lit((1 << 62) - 1)))
    with_id.select(*struct(ddl).fieldNames()).write.mode("append").parquet(path)


def log_queries(rows: DataFrame, base: str, cfg: Settings = Settings()) -> None:
    append_log(rows, os.path.join(base, cfg.log_path, "queries"), QUERY_LOG, ["timestamp", "query"])


def log_metrics(rows: DataFrame, base: str, cfg: Settings = Settings()) -> None:
    append_log(rows, os.path.join(base, cfg.log_path, "metrics"), EVAL_METRIC, ["timestamp", "query_log_id"])
