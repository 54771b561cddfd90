"""The document pipeline: filter by quality, drop copies and near copies, mix sources, pack.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns a table with
the columns of ``documents``; the last returns the packed pieces (see ``matchloom.llm.packing``). Between two
stages the rows are written as Parquet and read again.

Edge cases: a null or empty text is scored like any other; the empty texts that stay are one group of copies. Of equal or
near texts the rule of the operator names the one that stays; rows without a doc_id are never dropped as near
copies, and a row that repeats another is a copy of it. A null source is a source of its own. Columns beyond those of
``documents`` are handed on by the stages; names that begin with ``__`` are the stages' own. An empty table goes
through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import matchloom
from matchloom.llm.common import stored
from matchloom.llm.exact_dedup import drop_copies
from matchloom.llm.minhash_dedup import drop_near_copies
from matchloom.llm.mixing import mixed
from matchloom.llm.packing import pack_documents
from matchloom.llm.quality import score
from matchloom.llm.queries import QUALITY_METADATA, QUALITY_THRESHOLD, quality_model
from matchloom.llm.tokens import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the factorisation machine scores at the threshold or above. It learns from ``labels``."""
    matchloom.ship(spark)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, QUALITY_METADATA).filter(f"score >= {QUALITY_THRESHOLD}").select(docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts differ in blanks only."""
    matchloom.ship(spark)
    return drop_copies(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    matchloom.ship(spark)
    return drop_near_copies(docs, percent=85, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them: not at all, once or twice."""
    matchloom.ship(spark)
    return mixed(docs, share=1.5, most=2.0, weights=(3, 1, 2))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, each with its sequence and offset."""
    matchloom.ship(spark)
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("near dedup", keep_unlike),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: the first and the last stage need a trained model and a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage{number}")
    return docs
