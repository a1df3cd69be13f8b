"""Streaming forms of the temporal operators; beyond the batch operators' scope.

Counts of daily windows with a watermark feed the same thresholds that the batch operator
computes; the audit log's retention is kept by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, key: str, ts: str = "ts", span: str = "24 hours", late: str = "1 day") -> DataFrame:
    """(key, start, n) of tumbling windows; rows later than the watermark are dropped."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", span), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def flagged(counts: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Window counts over a static table of (key, threshold)."""
    return counts.join(baseline, key).where("n > threshold AND n >= 3")
