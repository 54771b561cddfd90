"""Streaming twin of ``latency_windows``: the same expression over a watermarked stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matchloom.operators.latency import latency_windows


def latency_stream(log: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Windows close when the watermark passes them; percentiles come from logarithmic buckets."""
    return latency_windows(log.withWatermark("ts", delay), width, exact=False)
