"""Store match runs and compare them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.functions.keys import filters_digest, text_digest
from matchloom.functions.text import HISTORY_DESCRIPTION_CHARS, clip_results, derive_label
from matchloom.operators.ranking import keep_newest
from matchloom.operators.runs import HISTORY_QUOTA
from matchloom.plans.matching import with_defaults


def to_runs(
    nested: DataFrame,
    requests: DataFrame,
    corpus_profile: str = "full",
    clip: int = HISTORY_DESCRIPTION_CHARS,
    quota: int | None = HISTORY_QUOTA,
) -> DataFrame:
    """One stored run per request: label, digests, settings and the clipped results in rank order.

    ``nested(query_id, match)``; ``requests`` carries ``user_id`` and ``created_at``. A run id is a
    digest of user, request and time, so a rerun of the job writes the same ids. The list of a run
    has at most ``top_n`` results.
    """
    lists = nested.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("match.rank").alias("rank"), "match"))).alias("_sorted")
    )
    full = with_defaults(requests)
    results = F.transform("_sorted", lambda e: e["match"])
    runs = full.join(lists, "query_id", "left").select(
        F.substring(
            F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.col("query_id").cast("string"),
                               F.col("created_at").cast("string")), 256), 1, 32,
        ).alias("run_id"),
        "user_id",
        "created_at",
        derive_label("query_text").alias("label"),
        text_digest("query_text").alias("resume_hash"),
        F.col("query_text").alias("resume_text"),
        "top_k",
        "top_n",
        F.struct("job_families", "min_score").alias("filters"),
        filters_digest("job_families", "min_score", True).alias("filters_digest"),
        clip_results(results, clip).alias("results"),
        F.lit(corpus_profile).alias("corpus_profile"),
    )
    if quota is None:
        return runs
    return keep_newest(runs, ["user_id"], [F.desc("created_at"), F.desc("run_id")], quota)
