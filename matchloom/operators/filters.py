"""Row predicates: families, scores, corpus rows, requests, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.functions.scores import sigmoid

# Request bounds and defaults.
MIN_RESUME_CHARS, MAX_RESUME_CHARS = 40, 20_000
MAX_TOP_K, MAX_TOP_N = 200, 50
DEFAULT_TOP_K, DEFAULT_TOP_N = 30, 10
OVERFETCH = 3


def in_families(family: str, families: Sequence[str] | Column | None) -> Column:
    """True without a filter or with an empty one; ``families`` may be an array column per row."""
    if families is None:
        return F.lit(True)
    if isinstance(families, Column):
        return families.isNull() | (F.size(families) == 0) | F.coalesce(
            F.array_contains(families, F.col(family)), F.lit(False)
        )
    return F.coalesce(F.col(family).isin(*families), F.lit(False)) if families else F.lit(True)


def reaches(score: str, min_score: float | Column | None) -> Column:
    """True when the probability of the logit reaches ``min_score``, or when either is missing."""
    if min_score is None:
        return F.lit(True)
    bound = min_score if isinstance(min_score, Column) else F.lit(min_score)
    return bound.isNull() | F.col(score).isNull() | (sigmoid(score) >= bound)


def apply_filters(
    df: DataFrame,
    families: Sequence[str] | Column | None = None,
    min_score: float | Column | None = None,
    family: str = "job_family",
    score: str = "cross_encoder_score",
) -> DataFrame:
    """Family filter, then score filter. Before reranking there is no score, so only families count."""
    kept = df.filter(in_families(family, families))
    return kept.filter(reaches(score, min_score)) if score in df.columns else kept


def effective_k(top_k: str, families: str, factor: int = OVERFETCH) -> Column:
    """Depth of retrieval: ``factor`` times as deep when a family filter is set."""
    wanted = F.col(families)
    filtered = wanted.isNotNull() & (F.size(wanted) > 0)
    return F.when(filtered, F.col(top_k) * factor).otherwise(F.col(top_k))


def request_problems(df: DataFrame) -> DataFrame:
    """Add ``reasons``: every bound a request breaks (empty when valid)."""
    length = F.length(F.coalesce("resume_text", F.lit("")))
    checks = [
        F.when(length < MIN_RESUME_CHARS, F.lit("resume_text too short")),
        F.when(length > MAX_RESUME_CHARS, F.lit("resume_text too long")),
        F.when(F.col("top_k").isNull() | ~F.col("top_k").between(1, MAX_TOP_K), F.lit("top_k out of range")),
        F.when(F.col("top_n").isNull() | ~F.col("top_n").between(1, MAX_TOP_N), F.lit("top_n out of range")),
        F.when(~F.col("min_score").between(0.0, 1.0), F.lit("min_score out of range")),
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) requests; rejected ones keep their ``reasons``."""
    checked = request_problems(df)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def purge_sessions(sessions: DataFrame, now: Column, revoked_before: Column) -> DataFrame:
    """Sessions that stay: not expired, and not revoked before the cutoff."""
    stale = (F.col("expires_at") <= now) | F.coalesce(F.col("revoked_at") < revoked_before, F.lit(False))
    return sessions.filter(~stale)


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that are neither revoked nor expired and belong to an active user."""
    open_ = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return open_.join(users.filter("is_active").select("user_id"), "user_id", "left_semi")
