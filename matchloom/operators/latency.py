"""Windowed latency and error rate, the same windows for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.operators.metrics import histogram_points, latency_percentiles, log_bucket


def latency_windows(log: DataFrame, width: str = "1 hour", exact: bool = True) -> DataFrame:
    """``start, path, requests, errors, error_rate, p50, p95, p99`` per tumbling window and path.

    ``log(ts, path, status, took_ms)``. ``exact`` interpolates linearly and needs a batch; without it the percentiles
    come from counts by window, path and logarithmic bucket (see ``operators.metrics.log_bucket``), which a stream
    can add up too. Requests without a time count, but not in the percentiles.
    """
    window = F.window("ts", width)
    counts = [F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors")]
    if exact:
        windowed = log.withColumn("start", window["start"])
        grouped = windowed.groupBy("start", "path").agg(*counts)
        points = latency_percentiles(windowed, "took_ms", ["start", "path"])
        grouped = grouped.join(points, ["start", "path"], "left")
    else:
        by_bucket = log.groupBy(window.alias("_w"), "path", log_bucket("took_ms").alias("bucket")).agg(*counts)
        one = F.struct("bucket", F.col("requests").alias("n"))
        merged = by_bucket.groupBy("_w", "path").agg(
            F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
            F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), one))).alias("_h"),
        )
        grouped = merged.select(F.col("_w.start").alias("start"), "path", "requests", "errors", *histogram_points(F.col("_h")))
    return grouped.withColumn("error_rate", F.col("errors") / F.col("requests"))
