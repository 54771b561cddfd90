"""Corpus build: clean, label, split, embed, weigh."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.functions.keys import category_key
from matchloom.functions.taxonomy import FAMILIES, Taxonomy, derive_family
from matchloom.functions.text import clean_text, embedding_text, join_parts, normalize_text
from matchloom.operators.encoding import HASHING_MODEL, Encoder, check_vectors, encode_incremental, hashing_encoder
from matchloom.operators.idf import build_idf
from matchloom.operators.layout import spread
from matchloom.operators.ranking import keep_first, with_ingest_order
from matchloom.operators.sampling import attach_texts, build_pairs, extra_categories, holdout, stratified_sample
from matchloom.sources.csv import POSTING_ALIASES, RESUME_ALIASES, read_aliased_csv
from matchloom.sources.tables import read_table, write_idf, write_table

POSTING_COLUMNS = ["job_id", "job_title", "description", "skills", "text", "job_category", "job_family"]
RESUME_COLUMNS = ["resume_id", "category", "resume_category", "resume_text_raw", "text"]

# Demo corpus size, floor per family, description cap.
DEMO_SIZE, DEMO_FLOOR, DEMO_CHARS = 25_000, 200, 1200


def _identified(raw: DataFrame, name: str) -> DataFrame:
    ordered = spread(with_ingest_order(raw), raw)
    if name not in raw.columns:
        return ordered.withColumn(name, F.col("ingest_ord"))
    numeric = F.col(name).try_cast("long")
    return ordered.filter(F.col(name).isNull() | numeric.isNotNull()).withColumn(name, numeric)


def rejected_ids(raw: DataFrame, name: str) -> DataFrame:
    """``name`` of the rows whose id is no whole number. ``clean_postings`` and ``clean_resumes`` leave
    these rows out, since everything that follows joins on numbers; nothing is merged under a null id."""
    if name not in raw.columns:
        return raw.sparkSession.createDataFrame([], f"`{name}` string")
    return raw.filter(F.col(name).isNotNull() & F.col(name).try_cast("long").isNull()).select(F.col(name).cast("string"))


def _first_copies(df: DataFrame, key: str) -> DataFrame:
    """Keep-first on (id, text). The text takes part as a digest, so sorting compares short keys."""
    hashed = df.withColumn("_digest", F.sha2("text", 256))
    return keep_first(hashed, [key, "_digest"], ["ingest_ord"]).drop("_digest")


def clean_postings(raw: DataFrame, taxonomy: Taxonomy = FAMILIES, unicode: bool = True) -> DataFrame:
    """Cleaned postings from a raw scan with ``title`` (``job_id, description, skills`` optional)."""
    if "title" not in raw.columns:
        raise ValueError("postings need a title column")
    df = _identified(raw, "job_id").withColumnRenamed("title", "job_title")
    for name in ("job_title", "description", "skills"):
        df = clean_text(df, name)
    # each part is normalised once; the title's plain form also gives the category and the family
    df = df.withColumn("_title", normalize_text("job_title", unicode))
    parts = [F.col("_title"), normalize_text("description", unicode), normalize_text("skills", unicode)]
    df = df.withColumn("text", join_parts(*parts)).filter(F.col("text") != "")
    return (
        _first_copies(df, "job_id")
        .withColumn("job_category", category_key("_title", unicode=False))
        .withColumn("job_family", derive_family("_title", taxonomy, unicode=False))
        .select(*POSTING_COLUMNS)
    )


def clean_resumes(raw: DataFrame, unicode: bool = True) -> DataFrame:
    """Cleaned resumes from a raw scan with ``category`` and ``resume_text``."""
    if not {"category", "resume_text"} <= set(raw.columns):
        raise ValueError("resumes need a category and a text column")
    df = _identified(raw, "resume_id").withColumnRenamed("resume_text", "resume_text_raw")
    for name in ("category", "resume_text_raw"):
        df = clean_text(df, name)
    df = df.withColumn("text", normalize_text("resume_text_raw", unicode))
    df = df.filter((F.col("category") != "") & (F.col("text") != ""))
    return (
        _first_copies(df, "resume_id")
        .withColumn("resume_category", category_key("category", unicode))
        .select(*RESUME_COLUMNS)
    )


def prepare_corpus(
    spark: SparkSession,
    jobs_path: str,
    resumes_path: str,
    out: str,
    taxonomy: Taxonomy = FAMILIES,
    negative_ratio: int = 3,
    positives: int = 1,
    fraction: float = 0.2,
    seed: int = 42,
    with_texts: bool = True,
    multi_line: bool = True,
) -> Mapping[str, DataFrame]:
    """Raw CSVs to six tables under ``out``: postings, resumes, pairs, train, eval, and rejected, the ids
    (``source, id``) of rows whose id is no number.

    Each table is written before the next step reads it, which cuts the lineage between the steps.
    ``with_texts=False`` keeps pairs as ids; ``attach_texts`` brings the texts back.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        write_table(df, f"{out}/{name}")
        return read_table(spark, f"{out}/{name}")

    raw_postings = read_aliased_csv(spark, jobs_path, POSTING_ALIASES, multi_line, placed=True)
    raw_resumes = read_aliased_csv(spark, resumes_path, RESUME_ALIASES, multi_line, placed=True)
    postings = stored(clean_postings(raw_postings, taxonomy), "postings")
    resumes = stored(clean_resumes(raw_resumes), "resumes")
    bad = [
        rejected_ids(raw, name).select(F.lit(source).alias("source"), F.col(name).alias("id"))
        for raw, name, source in ((raw_postings, "job_id", "postings"), (raw_resumes, "resume_id", "resumes"))
    ]
    rejected = stored(bad[0].unionByName(bad[1]), "rejected")
    extra = extra_categories(resumes, taxonomy)
    drawn = build_pairs(resumes, postings, taxonomy, negative_ratio, positives, seed, categories=extra)
    pairs = stored(attach_texts(drawn, resumes, postings) if with_texts else drawn, "pairs")
    train, held = holdout(pairs, fraction, seed=seed)
    return {
        "postings": postings,
        "resumes": resumes,
        "pairs": pairs,
        "train": stored(train, "train"),
        "eval": stored(held, "eval"),
        "rejected": rejected,
    }


def build_vectors(
    postings: DataFrame,
    encoder: Encoder | None = None,
    cache: DataFrame | None = None,
    model: str = HASHING_MODEL,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(``item_id, vec`` for every posting, vectors to append to the store)."""
    missing = {"job_id", "job_title", "text"} - set(postings.columns)
    if missing:
        raise ValueError(f"postings lack {sorted(missing)}")
    composed = postings.select("job_id", embedding_text("job_title", "text").alias("_body"))
    encoded, fresh = encode_incremental(composed, "_body", cache, encoder or hashing_encoder(), model)
    vectors = encoded.select(F.col("job_id").alias("item_id"), F.col("embedding").alias("vec"))
    if check:
        check_vectors(vectors, "item_id", "vec")
    return vectors, fresh


def build_weights(postings: DataFrame, path: str) -> DataFrame:
    """Build the IDF table over the posting texts, store it and read it back."""
    write_idf(build_idf(postings), path)
    return read_table(postings.sparkSession, path)


def demo_corpus(
    postings: DataFrame,
    target: int = DEMO_SIZE,
    floor: int = DEMO_FLOOR,
    max_chars: int = DEMO_CHARS,
    seed: int = 42,
    taxonomy: Taxonomy = FAMILIES,
    unicode: bool = True,
) -> DataFrame:
    """Stratified sample by family with cut descriptions and ``text`` rebuilt from the cut fields.
    Duplicate ids in the sample are an error."""
    df = postings
    if "job_family" not in df.columns:
        df = df.withColumn("job_family", derive_family("job_title", taxonomy, unicode=unicode))
    for name in ("description", "skills"):
        df = clean_text(df, name) if name not in df.columns else df.withColumn(name, F.coalesce(name, F.lit("")))
    sample = stratified_sample(df, "job_family", target, floor, seed)
    parts = [normalize_text(c, unicode) for c in ("job_title", "description", "skills")]
    demo = sample.withColumn("description", F.substring("description", 1, max_chars)).withColumn(
        "text", join_parts(*parts)
    )
    if sample.select("job_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect():
        raise ValueError("duplicate job_id in the sample")
    return demo
