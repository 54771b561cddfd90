"""Retrieve and match many requests in one job.

A request row has ``query_id, query_text`` and, optionally, ``top_k, top_n, job_families, min_score,
explain, vec``; missing columns take the defaults, a missing ``vec`` is encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window as W, functions as F

from matchloom.functions.keys import filters_digest, request_key, text_digest
from matchloom.functions.skills import Skill
from matchloom.functions.text import SCORING_TEXT_CHARS, is_blank, squeeze
from matchloom.operators.encoding import Encoder, hashing_encoder
from matchloom.operators.filters import (
    DEFAULT_TOP_K,
    DEFAULT_TOP_N,
    effective_k,
    in_families,
    reaches,
)
from matchloom.operators.knn import knn_exact
from matchloom.operators.layout import checkpointed
from matchloom.operators.matching import PAIR, Scorer, assemble, explain, hydrate, lexical_scorer, rerank
from matchloom.operators.ranking import keep_first
from matchloom.sources.schemas import EXPLANATION

Search = Callable[[DataFrame, DataFrame, int], DataFrame]


class Matches(NamedTuple):
    """``results``: query_id, job_id, scores, ranks, explanation. ``counts``: per request, how many
    candidates were retrieved and how many survived the filters."""

    results: DataFrame
    counts: DataFrame


def with_defaults(requests: DataFrame) -> DataFrame:
    """The request columns in full."""
    given = {
        "top_k": F.lit(DEFAULT_TOP_K),
        "top_n": F.lit(DEFAULT_TOP_N),
        "job_families": F.lit(None).cast("array<string>"),
        "min_score": F.lit(None).cast("double"),
        "explain": F.lit(True),
    }
    for name, default in given.items():
        requests = requests.withColumn(name, F.coalesce(name, default) if name in requests.columns else default)
    return requests


def retrieve(
    requests: DataFrame,
    postings: DataFrame,
    vectors: DataFrame,
    encoder: Encoder | None = None,
    search: Search = knn_exact,
    overfetch: bool = True,
) -> DataFrame:
    """``query_id, job_id, bi_encoder_score, retrieval_rank, job_family``.

    Blank text or ``top_k <= 0`` retrieves nothing. The search depth is the deepest one asked for;
    each request then keeps its own depth. A vector without a posting is dropped, its rank is not
    given to another. Only ids and families are joined here; texts join when they are needed.
    """
    asked = with_defaults(requests).filter(~is_blank("query_text") & (F.col("top_k") > 0))
    asked = asked.withColumn("depth", effective_k("top_k", "job_families") if overfetch else F.col("top_k"))
    if "vec" not in asked.columns:
        asked = (encoder or hashing_encoder())(asked.withColumn("_text", squeeze("query_text")), "_text", "vec")
    # ids, depths and vectors only: the search reads them several times, the encoder must run once
    asked = checkpointed(asked.select("query_id", "depth", "vec"))
    deepest = asked.agg(F.max("depth").alias("d")).first().d or 0
    hits = search(asked.select("query_id", "vec"), vectors, int(deepest)).select(
        "query_id",
        F.col("item_id").alias("job_id"),
        F.col("score").alias("bi_encoder_score"),
        "retrieval_rank",
    )
    own_depth = hits.join(asked.select("query_id", "depth"), "query_id").filter("retrieval_rank <= depth")
    return own_depth.drop("depth").join(postings.select("job_id", "job_family"), "job_id")


def match(
    requests: DataFrame,
    postings: DataFrame,
    vectors: DataFrame,
    idf: DataFrame,
    encoder: Encoder | None = None,
    scorer: Scorer | None = None,
    search: Search = knn_exact,
    lexicon: Sequence[Skill] = (),
    chars: int | None = SCORING_TEXT_CHARS,
) -> Matches:
    """Over-fetch, family filter, rerank, score filter, cut, explain the survivors.

    The candidate list (ids and scores, at most depth rows per request) is checkpointed: the counts
    and the results both start from it. So is ``idf``, which the scorer and the explanations read. The default scorer and the explanations read ``chars`` characters of a text,
    all of them when it is None; ``idf`` should have been built with the same number.
    """
    requests = with_defaults(requests)
    idf = checkpointed(idf.select("term", "idf"))
    queries = requests.select("query_id", "query_text")
    settings = requests.select("query_id", "top_n", "job_families", "min_score", "explain")
    candidates = checkpointed(retrieve(requests, postings, vectors, encoder, search))
    eligible = candidates.join(settings, "query_id").filter(in_families("job_family", F.col("job_families")))
    ranked = rerank(
        eligible.select(*PAIR, "bi_encoder_score", "retrieval_rank", "job_family", "top_n", "min_score", "explain"),
        queries,
        postings,
        scorer or lexical_scorer(idf, chars),
    )
    survivors = checkpointed(ranked.filter(reaches("cross_encoder_score", F.col("min_score"))))
    retrieved = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_candidates"))
    kept = survivors.groupBy("query_id").agg(F.count(F.lit(1)).alias("filtered_candidates"))
    zero = F.lit(0).cast("long")
    counts = (
        queries.select("query_id", text_digest("query_text").alias("resume_hash"))
        .join(retrieved, "query_id", "left")
        .join(kept, "query_id", "left")
        .withColumn("total_candidates", F.coalesce("total_candidates", zero))
        .withColumn("filtered_candidates", F.coalesce("filtered_candidates", zero))
    )
    shown = survivors.filter(F.col("rank") <= F.col("top_n"))
    explained = explain(shown.filter("explain").select(*PAIR), queries, postings, idf, lexicon, chars=chars)
    results = shown.join(explained, PAIR, "left").select(
        *PAIR, "bi_encoder_score", "cross_encoder_score", "retrieval_rank", "rank", "explanation"
    )
    return Matches(results, counts)


def nested_results(matches: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, match``: results hydrated and assembled into the nested row."""
    return assemble(hydrate(matches, postings))


def retrieve_results(
    requests: DataFrame, postings: DataFrame, vectors: DataFrame, encoder: Encoder | None = None, search: Search = knn_exact
) -> DataFrame:
    """First stage only: the first ``top_n`` retrieved postings, unfiltered, unexplained, rerank score 0."""
    requests = with_defaults(requests)
    hits = retrieve(requests, postings, vectors, encoder, search, overfetch=False)
    most = requests.agg(F.max("top_n").alias("n")).first().n or 0  # a literal lets Spark cut before the shuffle
    ranked = hits.join(requests.select("query_id", "top_n"), "query_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("retrieval_rank"))
    return (
        ranked.withColumn("rank", place)
        .filter((F.col("rank") <= F.col("top_n")) & (F.col("rank") <= most))
        .select(*PAIR, "bi_encoder_score", F.lit(0.0).alias("cross_encoder_score"), "retrieval_rank", "rank",
                F.lit(None).cast(EXPLANATION).alias("explanation"))
    )


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Add ``request_key``."""
    full = with_defaults(requests)
    return full.withColumn(
        "request_key",
        request_key(
            text_digest("query_text"),
            F.col("top_k"),
            F.col("top_n"),
            filters_digest("job_families", "min_score", True),
            F.col("explain"),
        ),
    )


def match_distinct(requests: DataFrame, run: Callable[[DataFrame], Matches]) -> DataFrame:
    """Match every distinct request once and hand the results to all who asked.

    ``run`` takes the distinct requests. Results carry the ``query_id`` of each requester; anything
    that belongs to a requester (a run id) is attached after this join, never before.
    """
    keyed = checkpointed(keyed_requests(requests))
    distinct = keep_first(keyed, ["request_key"], ["query_id"])
    results = run(distinct).results
    owners = distinct.select("request_key", F.col("query_id").alias("_owner"))
    asked = keyed.select("request_key", "query_id").join(owners, "request_key").drop("request_key")
    return results.withColumnRenamed("query_id", "_owner").join(asked, "_owner").drop("_owner")
