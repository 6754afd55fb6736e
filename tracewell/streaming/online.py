"""The same questions on a stream: event rates in time windows, and bursts by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, ts: str, key: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per key and time window: events and their sum. Works on a stream, where state older than `late` is dropped, and on a table."""
    rows = events.withColumn("ts_", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("ts_", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts_", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def bursts(events: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Per key: runs of events without a pause of `gap`, with their number."""
    rows = events.withColumn("ts_", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("ts_", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts_", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
