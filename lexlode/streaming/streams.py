"""Structured Streaming forms of ingestion, evaluation and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexlode.config import Settings
from lexlode.operators.ingest import ingest


def read_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(folder)


def _watermarked(events: DataFrame, time_col: str, late: str) -> DataFrame:
    """Event time as a stream needs it; tables stay as they are."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late) if events.isStreaming else events


def hourly_counts(events: DataFrame, time_col: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value", late: str = "1 hour") -> DataFrame:
    """Counts and sums per clock hour and key; works on streams (late rows up to ``late``) and on tables."""
    stream = _watermarked(events, time_col, late)
    return stream.groupBy(F.window(time_col, "1 hour").alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("hour"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, parted by gaps without events."""
    stream = _watermarked(events, time_col, late)
    return stream.groupBy(F.session_window(time_col, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_per_key(events: DataFrame, key: str, time_col: str = "ts", within: str = "1 hour") -> DataFrame:
    """Repeats of a key within a span of time dropped; the state is bounded by the watermark."""
    return _watermarked(events, time_col, within).dropDuplicatesWithinWatermark([key])


def ingest_stream(docs: DataFrame, base: str, checkpoint: str, cfg: Settings = Settings()) -> StreamingQuery:
    """Ingest a stream of documents batch by batch, by the same path as a table; a batch that is replayed adds nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        ingest(batch, base, cfg)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
