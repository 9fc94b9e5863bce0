"""Streaming stage statistics: counts per tumbling window and stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_stats_stream(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes",
                       time: str = "ts") -> DataFrame:
    """Per window and stage: rows, degradations and mean duration, with a watermark.

    Partial aggregation runs before the state shuffle, so a dominant stage is one row per
    partition and window.
    """
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("_w"), "stage")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("degradation_reason").alias("degraded"),
            F.sum("duration_ms").alias("total_ms"),
            F.max("duration_ms").alias("max_ms"),
        )
        .select(F.col("_w.start").alias("window_start"), "stage", "n", "degraded", "total_ms",
                "max_ms")
    )
