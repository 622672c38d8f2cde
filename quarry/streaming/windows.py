"""Structured Streaming over event tables: the same transformations serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str = "1 hour", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of each kind by window; a stream drops what comes later than ``late``."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), key, "n")


def distinct(events: DataFrame, keys: list[str], late: str = "1 hour", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there now and stop; the checkpoint makes a later call take up where this one ended."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
