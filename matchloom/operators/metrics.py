"""Evaluation and report aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom.functions.taxonomy import OTHER
from matchloom.functions.text import family_label
from matchloom.operators.layout import checkpointed
from matchloom.operators.ranking import top_n


def family_facet(df: DataFrame, family: str = "job_family") -> DataFrame:
    """``family, label, n``: biggest first, ``OTHER`` last."""
    return (
        df.groupBy(F.col(family).alias("family"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", family_label("family"))
        .orderBy(F.col("family") == OTHER, F.desc("n"), "family")
        .select("family", "label", "n")
    )


def corpus_summary(jobs: DataFrame, resumes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: counts, share of positive pairs, share of postings with a family."""

    def of(df: DataFrame, value: Column) -> Column:
        return df.agg(value.alias("v")).scalar()

    rows = F.count(F.lit(1))
    return resumes.agg(rows.alias("resumes"), F.countDistinct("resume_category").alias("resume_categories")).select(
        of(jobs, rows).alias("jobs"),
        of(jobs, F.avg((F.col("job_family") != OTHER).cast("double"))).alias("family_coverage"),
        of(jobs, F.countDistinct("job_category")).alias("job_categories"),
        "resumes",
        "resume_categories",
        of(pairs, rows).alias("pairs"),
        of(pairs, F.avg("relevance")).alias("positive_rate"),
    )


# The reported percentiles.
POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _key_join(by: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for column in by:
        same = same & F.col(column).eqNullSafe(F.col(f"{prefix}{column}"))
    return same


def _ranks(points: Mapping[str, float]) -> Column:
    edges = [edge(F.lit(p) * (F.col("_total") - 1)).cast("long") for p in points.values() for edge in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*edges))


def quantile_buckets(items: DataFrame, keys: Sequence[str], buckets: int, salts: int = 16) -> DataFrame:
    """``items`` with ``_bucket``: the number of quantile boundaries of its group (``keys``) at or below ``_v``.

    Boundaries are approximate quantiles of the group's rows, a mergeable sketch of fixed size, so a bucket holds a
    like share of the rows whatever the distribution; equal values share one. A sketch depends on the order it is merged
    in, so the boundaries, one array per group, are checkpointed: every later step sees the same ones. They are joined
    on the group and a salt, so a group with most rows is split.
    """
    inner = [i / buckets for i in range(1, buckets)]
    bounds = items.groupBy(*[F.col(k).alias(f"_q_{k}") for k in keys]).agg(
        F.percentile_approx("_v", inner, 20 * buckets).alias("_bounds")
    )
    bounds = checkpointed(bounds).withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int"))
    placed = salted.join(bounds, _key_join(keys, "_q_") & (F.col("_salt") == F.col("_q_salt")))
    below = F.size(F.filter("_bounds", lambda bound: bound <= F.col("_v")))
    return placed.withColumn("_bucket", below).drop("_bounds", "_salt", "_q_salt", *[f"_q_{k}" for k in keys])


def _narrowed(items: DataFrame, keys: Sequence[str], points: Mapping[str, float], buckets: int) -> DataFrame:
    """The items of the buckets that hold a wanted rank; ``_start`` becomes the number of values before the bucket."""
    placed = quantile_buckets(items, keys, buckets)
    sizes = placed.groupBy(*keys, "_bucket").agg(
        F.sum("_n").alias("_size"), F.first("_start").alias("_start"), F.first("_total").alias("_total")
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_start") + F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    holds = F.exists(_ranks(points), lambda r: (F.col("_first") <= r) & (r < F.col("_first") + F.col("_size")))
    wanted = sizes.withColumn("_first", start).filter(holds)
    wanted = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in (*keys, "_bucket")], "_first")
    kept = placed.join(wanted, _key_join([*keys, "_bucket"], "_w_"))
    return kept.withColumn("_start", F.col("_first")).drop("_first", *[f"_w_{k}" for k in (*keys, "_bucket")])


def exact_percentiles(
    df: DataFrame, value: str, by: Sequence[str], points: Mapping[str, float], buckets: int = 256, rounds: int = 2
) -> DataFrame:
    """Exact, linearly interpolated percentiles by distributed selection, without holding a group in one task.

    Equal values are merged map-side. Each round cuts what is left of a group at its own quantiles, counts the pieces and
    keeps those that hold the two ranks next to each point, so a long tail is cut as finely as the middle. After
    ``rounds`` a piece holds about ``buckets ** -rounds`` of a group's distinct values, and only the pieces left are put in
    order. The boundaries only steer the work: the result does not depend on them. Nulls don't count; groups without a
    value are left out; NaN is the largest value.
    """
    value_col = F.col(value).cast("double")
    counts = df.filter(value_col.isNotNull()).groupBy(*by, value_col.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.sum("_n").alias("_total"))
    salts = 16
    totals = totals.withColumn("_t_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int"))
    items = salted.join(totals, _key_join(by, "_t_") & (F.col("_salt") == F.col("_t_salt")))
    items = items.drop("_salt", "_t_salt", *[f"_t_{c}" for c in by]).withColumn("_start", F.lit(0).cast("long"))
    keys = list(by)
    for number in range(rounds):
        items = checkpointed(_narrowed(items, keys, points, buckets).withColumnRenamed("_bucket", f"_piece{number}"))
        keys.append(f"_piece{number}")
    inside = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ordered = items.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ordered = ordered.withColumn("_to", F.col("_from") + F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    low_high = []
    for name, point in points.items():
        exact_rank = F.lit(point) * (F.col("_total") - 1)
        low_high += [at(F.floor(exact_rank)).alias(f"_{name}_lo"), at(F.ceil(exact_rank)).alias(f"_{name}_hi")]
    found = ordered.groupBy(*by, "_total").agg(*low_high)

    def between(name: str, point: float) -> Column:
        part = F.lit(point) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (part - F.floor(part))).alias(name)

    return found.select(*by, *[between(n, p) for n, p in points.items()])


#: a value and its bucket's middle differ by at most this share of the value
RELATIVE_ERROR = 0.01


def log_bucket(value: Column | str, error: float = RELATIVE_ERROR) -> Column:
    """Number of the logarithmic bucket of a positive value: bucket i ends at ``gamma^i`` with ``gamma = (1 + error) / (1 -
    error)``. Zero and less have the bucket below all others; null has none."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    gamma = (1 + error) / (1 - error)
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(gamma))).cast("int")).when(value <= 0, F.lit(LOWEST_BUCKET))


LOWEST_BUCKET = -(1 << 20)


def bucket_value(bucket: Column, error: float = RELATIVE_ERROR) -> Column:
    """The value that stands for a bucket: within ``error`` of all its values."""
    gamma = (1 + error) / (1 - error)
    return F.when(bucket == LOWEST_BUCKET, F.lit(0.0)).otherwise(F.lit(2.0) * F.pow(F.lit(gamma), bucket) / F.lit(gamma + 1))


def histogram_points(histogram: Column, points: Mapping[str, float] = POINTS) -> list[Column]:
    """Percentiles of a histogram, an array of ``(bucket, n)`` sorted by bucket: the bucket of the value of rank
    ``floor(point * (total - 1))``. Histograms merge by adding up, so they do over partitions, windows and batches."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda s, b: s + b["n"])

    def at(point: float) -> Column:
        rank = F.floor(F.lit(point) * (total - 1))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket"))
        found = F.aggregate(
            histogram,
            start,
            lambda s, b: F.struct(
                (s["seen"] + b["n"]).alias("seen"),
                F.when(s["bucket"].isNull() & (s["seen"] + b["n"] > rank), b["bucket"]).otherwise(s["bucket"]).alias("bucket"),
            ),
        )
        return bucket_value(found["bucket"])

    return [at(p).alias(name) for name, p in points.items()]


def latency_percentiles(
    df: DataFrame, value: str = "took_ms", by: Sequence[str] = (), exact: bool = True, error: float = RELATIVE_ERROR
) -> DataFrame:
    """p50, p95, p99. ``exact`` interpolates linearly; otherwise they come from a mergeable histogram of logarithmic
    buckets: two counts, of a few thousand buckets a group at most, and a relative error of ``error``."""
    if exact:
        return exact_percentiles(df, value, by, POINTS)
    counts = df.groupBy(*by, log_bucket(value, error).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter("bucket IS NOT NULL")
    grouped = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("_h"))
    return grouped.select(*by, *histogram_points(F.col("_h")))


def candidate_counts(candidates: DataFrame, by: str = "query_id", survived: str = "survived") -> DataFrame:
    """``total_candidates`` before filters and ``filtered_candidates`` that survived them."""
    return candidates.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_candidates"), F.count_if(survived).alias("filtered_candidates")
    )


def attach_truth(
    results: DataFrame, truth: DataFrame, on: Sequence[str] = ("query_id", "job_id"), label: str = "relevance"
) -> DataFrame:
    """Label results from the truth table; an unlabelled pair is 0."""
    return results.join(truth.select(*on, label), list(on), "left").withColumn(
        label, F.coalesce(label, F.lit(0))
    )


def _gain(df: DataFrame, value: str, by: str, k: int, name: str) -> DataFrame:
    """Discounted gain of the first ``k`` places ordered by ``value``; equal values share their places.

    Equal values are merged first, so at most ``k`` merged rows per query matter and the rest is cut
    before the shuffle. The discounts of places a+1..b come as a difference of prefix sums.
    """
    prefix = [0.0]
    for place in range(1, k + 1):
        prefix.append(prefix[-1] + 1 / math.log2(place + 1))
    table = F.array(*[F.lit(p) for p in prefix])

    def upto(places: Column) -> Column:
        return F.element_at(table, (F.least(places, F.lit(k)) + 1).cast("int"))

    merged = df.groupBy(by, value).agg(F.sum("_label").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    first = top_n(merged, [by], [F.desc(value)], k)
    order = W.partitionBy(by).orderBy(F.desc(value))
    return (
        first.withColumn("_end", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_part", F.col("_sum") / F.col("_n") * (upto(F.col("_end")) - upto(F.col("_start"))))
        .groupBy(by)
        .agg(F.sum("_part").alias(name))
    )


def ndcg(
    df: DataFrame,
    k: int = 10,
    by: str = "query_id",
    score: str = "score",
    label: str = "relevance",
    ideal: DataFrame | None = None,
) -> DataFrame:
    """``by, ndcg``: linear gain, 1/log2(place+1) discount, tied scores share their average gain.

    The ideal order is taken over the retrieved list, or over ``ideal`` (rows with the same label
    column) when given. All labels 0 gives 0; a list of one document gives NULL.
    """
    rows = df.withColumn("_label", F.col(label).cast("double"))
    best = rows if ideal is None else ideal.withColumn("_label", F.col(label).cast("double"))
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    value = F.when(F.col("_size") > 1, F.coalesce(F.col("_dcg") / F.nullif(F.col("_ideal"), F.lit(0.0)), F.lit(0.0)))
    return (
        sizes.join(_gain(rows, score, by, k, "_dcg"), by)
        .join(_gain(best.withColumn("_value", F.col("_label")), "_value", by, k, "_ideal"), by, "left")
        .select(by, value.alias("ndcg"))
    )


def mean_ndcg(per_query: DataFrame, truth: DataFrame, by: str = "query_id", label: str = "relevance") -> DataFrame:
    """Mean over the queries that have a relevant document in the truth table."""
    relevant = truth.filter(F.col(label) > 0).select(by)
    return per_query.join(relevant, by, "left_semi").agg(
        F.count("ndcg").alias("queries"), F.avg("ndcg").alias("mean_ndcg")
    )


def recall_at_k(approx: DataFrame, exact: DataFrame, by: str = "query_id", item: str = "item_id") -> DataFrame:
    """Share of the exact hits the approximate search found, per query."""
    found = approx.select(by, item, F.lit(1).alias("_found"))
    return (
        exact.select(by, item)
        .join(found, [by, item], "left")
        .groupBy(by)
        .agg(F.avg(F.coalesce("_found", F.lit(0))).alias("recall"))
    )
