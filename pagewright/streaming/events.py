"""Streams of stage events: an extension, as the engine's own operators are batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_each: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def windowed_totals(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, stage, calls, micros) in tumbling or sliding windows of ts; rows later than the watermark are dropped. events: ts, stage, micros."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    totals = events.withWatermark("ts", late).groupBy(span.alias("w"), "stage").agg(F.count("*").alias("calls"), F.sum("micros").alias("micros"))
    return totals.select("w.start", "w.end", "stage", "calls", "micros")


def sessions(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, calls): runs of a key's events without a longer gap."""
    totals = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls"))
    return totals.select(key, "w.start", "w.end", "calls")


def first_seen(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Events whose key wasn't seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
