"""Ledgers and events as streams. An extension: windows and watermarks have no counterpart in batch gating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "candidate string, verdict string, trials_before int, trials_after int, escalation_multiplier double, timestamp_utc string"


def trials(spark: SparkSession, path: str) -> DataFrame:
    """New ledger lines as they are appended."""
    return spark.readStream.schema(LEDGER).json(path).withColumn("ts", F.to_timestamp("timestamp_utc"))


def activity(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by tumbling window and type; those later than ``late`` are left out. Batch tables work too."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "30 minutes") -> DataFrame:
    """Sessions of a user: a gap without events ends one. A stalled queue is a session that is long over."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
