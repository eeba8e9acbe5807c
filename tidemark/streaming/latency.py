"""Sliding-window request rate and latency quantile with lateness.

The streaming aggregation keeps only per-(window, endpoint) bucket
counts in state; the quantile is a per-row projection of those counts
(A18 as a Column expression), so it runs in append mode and the window
is emitted once the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.telemetry import LATENCY_BUCKETS, bucket_counts, quantile_from_counts


def windowed_latency_stream(events: DataFrame, q: float = 0.95, window: str = "5 minutes",
                            slide: str = "1 minute", delay: str = "10 minutes", bounds=LATENCY_BUCKETS,
                            window_seconds: int = 300, ts: str = "ts", duration: str = "duration") -> DataFrame:
    """Streaming (or batch) frame: window_start, window_end, endpoint, rate, p_quantile."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, window, slide), "endpoint")
    agg = w.agg(F.count(F.lit(1)).alias("n"), F.array(*bucket_counts(bounds, duration)).alias("cum"))
    return agg.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"), "endpoint",
        (F.col("n") / F.lit(float(window_seconds))).alias("rate"),
        quantile_from_counts(F.col("cum"), bounds, q).alias("p_quantile"))
