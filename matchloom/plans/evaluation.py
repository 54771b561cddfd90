"""Evaluate retrieval alone against retrieval with reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.operators.metrics import attach_truth, mean_ndcg, ndcg


def evaluate(results: DataFrame, truth: DataFrame, score: str, k: int = 10) -> DataFrame:
    """``query_id, ndcg`` of one result list per query; ``truth(query_id, job_id, relevance)``."""
    return ndcg(attach_truth(results, truth), k, score=score)


def compare_systems(retrieved: DataFrame, reranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row per system: number of scored queries and mean NDCG@k."""
    systems = {"retrieval": (retrieved, "bi_encoder_score"), "reranked": (reranked, "cross_encoder_score")}
    rows = [
        mean_ndcg(evaluate(results, truth, score, k), truth).withColumn("system", F.lit(name))
        for name, (results, score) in systems.items()
    ]
    return rows[0].unionByName(rows[1]).select("system", "queries", "mean_ndcg")
