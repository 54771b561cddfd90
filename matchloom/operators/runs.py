"""Match history: merges, summaries, comparison, skill gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.operators.ranking import keep_newest, quota_overflow, top_n

# History quota, preview titles, skill-gap sample and length.
HISTORY_QUOTA = 200
PREVIEW_TITLES = 3
GAP_SAMPLE, GAP_SHOWN = 10, 8

RUN_KEY = ["user_id", "resume_hash", "top_k", "top_n", "filters_digest"]


def import_runs(
    existing: DataFrame, incoming: DataFrame, quota: int | None = HISTORY_QUOTA, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Merge imported runs: (runs after the merge, counts per importing user).

    Runs are equal when ``RUN_KEY`` is. A new key is inserted with its first entry in ``seq`` order;
    every further entry, and any entry of a known key, is a duplicate that can only move
    ``created_at`` back. Among existing runs of one key (they are not collapsed) the one with the
    highest ``run_id`` is moved. ``incoming`` has the columns of ``existing`` and ``seq``; the new
    ``run_id`` is the entry's. Counts: imported, skipped_duplicate, skipped_quota.
    """
    columns = existing.columns
    first = (
        incoming.groupBy(*RUN_KEY)
        .agg(
            F.min_by(F.struct(*columns), seq).alias("_first"),
            F.min("created_at").alias("_earliest"),
            F.count(F.lit(1)).alias("_entries"),
        )
        .select(*[F.col(k).alias(f"_k_{k}") for k in RUN_KEY], "_first", "_earliest", "_entries")
    )
    same = [F.col(k) == F.col(f"_k_{k}") for k in RUN_KEY]
    targets = top_n(existing.select(*RUN_KEY, "run_id"), RUN_KEY, [F.desc("run_id")], 1)
    moved = targets.join(first, same).select("run_id", "_earliest")
    kept = existing.join(moved, "run_id", "left").withColumn(
        "created_at", F.least("created_at", "_earliest")
    ).select(*columns)
    fresh = first.join(targets, same, "left_anti")
    inserted = fresh.select(
        *[F.col("_earliest").alias(c) if c == "created_at" else F.col(f"_first.{c}").alias(c) for c in columns]
    )
    merged = kept.unionByName(inserted)
    user = F.col("_k_user_id").alias("user_id")
    counts = (
        first.groupBy(user)
        .agg(F.sum("_entries").alias("_entries"))
        .join(fresh.groupBy(user).agg(F.count(F.lit(1)).alias("_new")), "user_id", "left")
        .select(
            "user_id",
            F.coalesce("_new", F.lit(0)).alias("imported"),
            (F.col("_entries") - F.coalesce("_new", F.lit(0))).alias("skipped_duplicate"),
        )
    )
    if quota is None:
        return merged, counts.withColumn("skipped_quota", F.lit(0).cast("long"))
    dropped = quota_overflow(merged, ["user_id"], quota, "skipped_quota")
    runs = keep_newest(merged, ["user_id"], [F.desc("created_at"), F.desc("run_id")], quota)
    return runs, counts.join(dropped, "user_id")


def run_summary(runs: DataFrame, results: str = "results") -> DataFrame:
    """Runs without their payload: number of results and the first three titles."""
    titles = F.transform(F.slice(results, 1, PREVIEW_TITLES), lambda r: r["job_title"])
    return (
        runs.withColumn("result_count", F.size(results)).withColumn("top_job_titles", titles).drop(results)
    )


def rank_movement(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Jobs in both result lists with both ranks; ``movement`` is rank_a - rank_b."""
    by = by or []
    left = a.select(*by, "job_id", F.col("rank").alias("rank_a"))
    right = b.select(*by, "job_id", F.col("rank").alias("rank_b"))
    return left.join(right, [*by, "job_id"]).withColumn("movement", F.col("rank_a") - F.col("rank_b"))


def skill_set(results: DataFrame, by: list[str], skills: str = "matched_skills") -> DataFrame:
    """``skill`` rows: the distinct skills per run."""
    return results.select(*by, F.explode(skills).alias("skill")).distinct()


def skill_difference(a: DataFrame, b: DataFrame, by: list[str], skills: str = "matched_skills") -> DataFrame:
    """``side, skill``: skills only one of two runs has."""
    left, right = skill_set(a, by, skills), skill_set(b, by, skills)
    keys = [*by, "skill"]
    only_a = left.join(right, keys, "left_anti").withColumn("side", F.lit("A"))
    only_b = right.join(left, keys, "left_anti").withColumn("side", F.lit("B"))
    return only_a.unionByName(only_b)


def compare_runs(runs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare two stored runs: (rank movement, skills of one side only, whether the corpora differ)."""

    def results(run_id: str) -> DataFrame:
        return runs.filter(F.col("run_id") == run_id).select(F.explode("results").alias("r")).select(
            "r.job_id", "r.job_title", "r.rank", "r.explanation.matched_skills"
        )

    left, right = results(a), results(b)
    titled = rank_movement(left, right).join(left.select("job_id", "job_title"), "job_id")
    corpora = runs.filter(F.col("run_id").isin(a, b)).agg(
        (F.count_distinct("corpus_profile") > 1).alias("corpora_differ")
    )
    return titled, skill_difference(left, right, []), corpora


def skill_gap(
    explained: DataFrame, by: str = "query_id", sample: int = GAP_SAMPLE, shown: int = GAP_SHOWN,
    missing: str = "missing_skills",
) -> DataFrame:
    """``by, skill, n``: the skills most often missing in the first ``sample`` results of a run; more
    often first, then by name. A null list contributes nothing."""
    counts = (
        explained.filter(F.col("rank") <= sample)
        .select(by, F.explode(missing).alias("skill"))
        .groupBy(by, "skill")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_n(counts, [by], [F.desc("n"), F.asc("skill")], shown)
