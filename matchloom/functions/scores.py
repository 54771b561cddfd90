"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Scores are rounded to this many decimals before they are ranked. Sums of doubles depend on the
# order of addition, which Spark does not fix; rounding makes ties, and so ranks, reproducible.
SCORE_DECIMALS = 6


def sigmoid(logit: Column | str) -> Column:
    logit = F.col(logit) if isinstance(logit, str) else logit
    return 1.0 / (1.0 + F.exp(-logit))


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)


def one_decimal(number: Column) -> Column:
    """Fixed-point text with one decimal, halves up."""
    return F.format_string("%.1f", F.floor(number * 10 + 0.5) / 10)


def to_percent(fraction: Column | str) -> Column:
    fraction = F.col(fraction) if isinstance(fraction, str) else fraction
    return fraction * 100.0


def scale_scores(df: DataFrame, score: str, by: str = "query_id", name: str = "scaled") -> DataFrame:
    """Min-max to 0..100 inside each shortlist; 100 when all scores are equal.

    The extremes come from a partially aggregated ``groupBy``, so no shortlist is gathered in one task.
    """
    ends = df.groupBy(by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    value = F.when(F.col("_high") == F.col("_low"), F.lit(100.0)).otherwise(
        (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")) * 100.0
    )
    return df.join(ends, by).withColumn(name, value).drop("_low", "_high")
