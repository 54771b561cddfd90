"""Hydration, pair scoring, reranking, explanation and result assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from matchloom.functions.scores import rounded, sigmoid
from matchloom.functions.skills import Skill, extract_skills
from matchloom.functions.taxonomy import OTHER
from matchloom.functions.text import (
    RESULT_DESCRIPTION_CHARS,
    SCORING_TEXT_CHARS,
    cap,
    first_non_empty,
    first_non_null,
    squeeze,
    tokens,
)
from matchloom.operators.key_filter import possible_rows
from matchloom.operators.layout import checkpointed

# Highlighted terms per match and the least IDF of a highlighted term.
MAX_TERMS_SHOWN = 12
MIN_IDF = 1.0

PAIR = ["query_id", "job_id"]

Scorer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def hydrate(hits: DataFrame, postings: DataFrame) -> DataFrame:
    """Hits with their posting. A hit without a posting goes, but its retrieval rank stays used up.

    Other postings are dropped where they are read, so only the hits' own are shuffled. The hits, which name the
    wanted postings and are joined with them, are checkpointed.
    """
    hits = checkpointed(hits)
    return hits.join(possible_rows(postings, hits, "job_id"), "job_id")


def posting_texts(postings: DataFrame, kind: str, chars: int | None = SCORING_TEXT_CHARS) -> DataFrame:
    """``job_id, body``. For scoring the first non-null of ``job_text, text, description``, squeezed
    and capped; for explaining the first non-empty one, capped as it is. Whole texts when ``chars`` is None."""
    present = [c for c in ("job_text", "text", "description") if c in postings.columns]
    if kind == "score":
        body = cap(squeeze(first_non_null(*present)), chars)
    else:
        body = cap(first_non_empty(*present), chars)
    return postings.select("job_id", body.alias("body"))


def wanted_texts(
    pairs: DataFrame, postings: DataFrame, kind: str, chars: int | None = SCORING_TEXT_CHARS
) -> DataFrame:
    """``posting_texts`` of the postings that stand in ``pairs``; the others are dropped where they are read,
    so neither their tokens nor their texts are computed or shuffled. ``pairs`` should be cheap to read."""
    wanted = pairs.select("job_id").distinct()
    needed = possible_rows(postings, wanted, "job_id").join(wanted, "job_id", "left_semi")
    return posting_texts(needed, kind, chars)


def shared_terms(pairs: DataFrame, idf: DataFrame, left: str = "query_terms", right: str = "job_terms") -> DataFrame:
    """``query_id, job_id, term, idf``: terms both token sets hold and the vocabulary knows.

    The sets are intersected inside the row, so only shared terms are exploded.
    """
    return pairs.select(*PAIR, F.explode(F.array_intersect(left, right)).alias("term")).join(
        idf.select("term", "idf"), "term"
    )


def term_codes(idf: DataFrame) -> tuple[Callable[[Column], Column], DataFrame]:
    """A function from an array of terms to the numbers of those in the vocabulary, and the table ``code, term, idf``.

    Two bytes for a term instead of its letters: term sets are sent once for every pair. The vocabulary is collected; by
    default ``build_idf`` keeps 50,000 terms.
    """
    known = idf.select("term", "idf").toArrow()
    terms, short = known.column("term").combine_chunks(), known.num_rows <= 1 << 16
    codes = np.arange(known.num_rows) - (1 << 15 if short else 0)
    codes = codes.astype(np.int16 if short else np.int32)

    @F.arrow_udf(T.ArrayType(T.ShortType() if short else T.IntegerType()))
    def coded(values: pa.Array) -> pa.Array:
        place = pc.index_in(values.flatten(), value_set=terms)
        of_row = np.repeat(np.arange(len(values)), pc.list_value_length(values).to_numpy(zero_copy_only=False))
        found = pc.is_valid(place).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.bincount(of_row[found], minlength=len(values)))
        numbers = pa.array(codes[place.drop_null().to_numpy()])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), numbers)

    return coded, idf.sparkSession.createDataFrame(known.append_column("code", pa.array(codes)))


def lexical_scorer(idf: DataFrame, chars: int | None = SCORING_TEXT_CHARS) -> Scorer:
    """Sum of the IDF of shared terms (query text whole, posting text capped at ``chars``, or whole). A stand-in for a neural
    pair model that needs no model; tokens are found once per text, not once per pair."""

    def score(pairs: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
        coded, known = term_codes(idf)
        asked = queries.select("query_id", coded(F.array_distinct(tokens("query_text"))).alias("query_terms"))
        offered = wanted_texts(pairs, postings, "score", chars).select(
            "job_id", coded(F.array_distinct(tokens("body"))).alias("job_terms")
        )
        sided = pairs.select(*PAIR).join(offered, "job_id").join(asked, "query_id")
        sums = shared_terms(sided, known.select(F.col("code").alias("term"), "idf")).groupBy(*PAIR).agg(F.sum("idf").alias("_sum"))
        return pairs.join(sums, PAIR, "left").withColumn(
            "cross_encoder_score", rounded(F.coalesce("_sum", F.lit(0.0)))
        ).drop("_sum")

    return score


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]]) -> Scorer:
    """Wrap a pair model ``[(query, text)] -> float[n]``; ``load`` runs once per Python worker.
    Posting texts are capped before they cross to Python."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for asked, offered in batches:
            yield pd.Series(np.asarray(model(list(zip(asked, offered))), dtype=np.float64))

    def score(pairs: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
        sided = pairs.join(wanted_texts(pairs, postings, "score"), "job_id").join(
            queries.select("query_id", "query_text"), "query_id"
        )
        return sided.withColumn("cross_encoder_score", run("query_text", "body")).drop("query_text", "body")

    return score


def rerank(pairs: DataFrame, queries: DataFrame, postings: DataFrame, scorer: Scorer, top_n: int | None = None) -> DataFrame:
    """Score the pairs and add ``rank``: score descending, ties in retrieval order. ``retrieval_rank``
    survives. ``pairs(query_id, job_id, retrieval_rank, ...)``."""
    scored = scorer(pairs, queries, postings)
    order = W.partitionBy("query_id").orderBy(F.desc("cross_encoder_score"), F.asc("retrieval_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if top_n is None else ranked.filter(F.col("rank") <= top_n)


def explain(
    pairs: DataFrame,
    queries: DataFrame,
    postings: DataFrame,
    idf: DataFrame,
    lexicon: Sequence[Skill] = (),
    max_terms: int = MAX_TERMS_SHOWN,
    min_idf: float = MIN_IDF,
    chars: int | None = SCORING_TEXT_CHARS,
) -> DataFrame:
    """``query_id, job_id, explanation``: matched and missing skills, weighted shared terms, overlap, over the first
    ``chars`` characters of both texts or, when it is None, over the whole texts.

    Skills and tokens are extracted once per query and once per posting that appears in ``pairs``.
    Both lists that need weights travel through one explode, one IDF join and one aggregation, whose
    groups are bounded by the distinct terms of a text.
    """
    coded, known = term_codes(idf)
    asked = queries.select("query_id", cap("query_text", chars).alias("_text")).select(
        "query_id",
        extract_skills("_text", lexicon).alias("_q_skills"),
        coded(F.array_distinct(tokens("_text"))).alias("_q_terms"),
    )
    offered = wanted_texts(pairs, postings, "explain", chars).select(
        "job_id",
        extract_skills("body", lexicon).alias("_j_skills"),
        coded(F.array_distinct(tokens("body"))).alias("_j_terms"),
    )

    kind = known.schema["code"].dataType
    term = F.transform(
        F.array_intersect("_q_terms", "_j_terms"),
        lambda c: F.struct(F.lit("term").alias("kind"), c.alias("code"), F.lit(None).cast("string").alias("skill")),
    )
    skill = F.transform(
        F.array_except("_j_skills", "_q_skills"),
        lambda s: F.struct(F.lit("skill").alias("kind"), F.lit(None).cast(kind).alias("code"), s.alias("skill")),
    )
    sided = (
        pairs.select(*PAIR)
        .join(offered, "job_id")
        .join(asked, "query_id")
        .select(
            *PAIR,
            F.array_intersect("_q_skills", "_j_skills").alias("matched_skills"),
            F.size("_j_skills").alias("_n_skills"),
            F.explode_outer(F.concat(term, skill)).alias("item"),
        )
        .select(*PAIR, "matched_skills", "_n_skills", "item.kind", "item.code", "item.skill")
        .join(known.select("code", "term"), "code", "left")
        .select(*PAIR, "matched_skills", "_n_skills", "kind", F.coalesce("term", "skill").alias("term"))
    )
    weight = F.coalesce("idf", F.lit(0.0))
    shown = (F.col("kind") == "term") & F.col("idf").isNotNull() & (F.col("idf") >= min_idf)
    entry = F.struct((-weight).alias("order"), F.col("term"), weight.alias("weight"))
    grouped = (
        sided.join(known.select("term", "idf"), "term", "left")
        .groupBy(*PAIR)
        .agg(
            F.first("matched_skills").alias("matched_skills"),
            F.first("_n_skills").alias("_n_skills"),
            F.array_sort(F.collect_list(F.when(shown, entry))).alias("_terms"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == "skill", entry))).alias("_missing"),
        )
    )
    return grouped.select(
        *PAIR,
        F.struct(
            F.array_sort("matched_skills").alias("matched_skills"),
            F.transform("_missing", lambda e: e["term"]).alias("missing_skills"),
            F.transform(
                F.slice("_terms", 1, max_terms),
                lambda e: F.struct(e["term"].alias("term"), e["weight"].alias("weight")),
            ).alias("matched_terms"),
            (F.size("matched_skills") / F.greatest(F.lit(1), F.col("_n_skills"))).alias("overlap_score"),
        ).alias("explanation"),
    )


def assemble(results: DataFrame, description_chars: int = RESULT_DESCRIPTION_CHARS) -> DataFrame:
    """``query_id, match``: the nested result row. Needs the hydrated columns, ``bi_encoder_score``,
    ``cross_encoder_score``, ``retrieval_rank``, ``rank`` and ``explanation`` (may be null)."""

    def text(name: str):
        present = F.col(name) if name in results.columns else F.lit(None)
        return F.coalesce(present, F.lit("")).alias(name)

    family = F.coalesce(F.nullif(F.col("job_family"), F.lit("")), F.lit(OTHER))
    bi = F.coalesce("bi_encoder_score", F.lit(0.0))
    cross = F.coalesce("cross_encoder_score", F.lit(0.0))
    overlap = F.coalesce(F.col("explanation.overlap_score"), F.lit(0.0))
    return results.select(
        "query_id",
        F.struct(
            "job_id",
            text("job_title"),
            cap(text("description"), description_chars).alias("description"),
            text("skills"),
            text("job_category"),
            family.alias("job_family"),
            bi.alias("bi_encoder_score"),
            cross.alias("cross_encoder_score"),
            F.struct(
                bi.alias("bi_encoder"),
                cross.alias("cross_encoder"),
                sigmoid(cross).alias("cross_encoder_probability"),
                overlap.alias("skill_overlap"),
            ).alias("scores"),
            F.col("explanation"),
            F.coalesce("retrieval_rank", "rank").cast("int").alias("retrieval_rank"),
            F.col("rank").cast("int").alias("rank"),
        ).alias("match"),
    )
