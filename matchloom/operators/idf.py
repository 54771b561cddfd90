"""Document frequency and smoothed IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.functions.text import SCORING_TEXT_CHARS, cap, tokens

# Fixed value: vocabulary size.
MAX_TERMS = 50_000


def document_frequency(df: DataFrame, text: str = "text", chars: int | None = SCORING_TEXT_CHARS) -> DataFrame:
    """``term, df`` over the capped texts, the whole ones when ``chars`` is None. Counts combine map-side, so frequent terms do not skew."""
    return (
        df.select(F.explode(F.array_distinct(tokens(cap(text, chars)))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def build_idf(
    df: DataFrame, text: str = "text", chars: int | None = SCORING_TEXT_CHARS, max_terms: int = MAX_TERMS
) -> DataFrame:
    """``term, df, idf`` with idf = ln((1+n)/(1+df)) + 1 for the ``max_terms`` most frequent terms.

    ``n`` counts every document, also one without a token.
    """
    n = df.select(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    return (
        document_frequency(df, text, chars)
        .orderBy(F.desc("df"), F.asc("term"))
        .limit(max_terms)
        .withColumn("idf", idf)
    )
