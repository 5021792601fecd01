"""Windows over the event table, the same expression for batch and for streams (beyond the catalogue's needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per hour; on a stream, rows later than ``late`` are left out by the watermark."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if events.isStreaming else ts
    g = ts.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("t"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("t").cast("double"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a pause of ``gap``."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if events.isStreaming else ts
    g = ts.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
