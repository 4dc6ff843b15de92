"""The batch operators cover everything asked for; tumbling windows here run the same on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_means(events: DataFrame, time: str, value: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """Count and mean of `value` by keys and event-time window; `late` sets the watermark of a stream."""
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean")
