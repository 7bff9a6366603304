"""Extension: the append-only event log as a stream. The reference behaviour has batch queries alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def counts_by_window(events: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of every window, final once the watermark has passed it."""
    marked = events.withWatermark(time, late)
    out = marked.groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
