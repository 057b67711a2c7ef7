"""A running tally over a stream of marks or events; an addition of ours, the studied system is batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum of value by tumbling window and key; in a stream, events later than `late` are dropped and closed windows are appended."""
    if events.isStreaming:  # watermarks need an instant
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
