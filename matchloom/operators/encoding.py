"""Text encoders and the incremental vector store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from matchloom.functions.keys import text_hash
from matchloom.functions.text import squeeze, tokens
from matchloom.operators.layout import checkpointed

# Name and width of the default encoder, and the encoder batch size.
HASHING_MODEL = "hashing-tf"
HASHING_DIM = 256
BATCH_SIZE = 64

Encoder = Callable[[DataFrame, str, str], DataFrame]


def hashing_encoder(dim: int = HASHING_DIM) -> Encoder:
    """The default without a model: hashed term frequencies, L2-normalised, JVM-side and in-row.

    It is a lexical stand-in for a neural encoder, not an equivalent.
    """

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(
            df.withColumn("_tokens", tokens(text))
        )
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")

    return encode


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = BATCH_SIZE) -> Encoder:
    """Wrap any ``texts -> float32[n, d]`` model. ``load`` runs once per Python worker; vectors are
    L2-normalised here. Texts are whitespace-squeezed before they cross to Python."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = texts.tolist()
            parts = [
                np.asarray(model(rows[i : i + batch_size]), dtype=np.float32)
                for i in range(0, len(rows), batch_size)
            ]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list(matrix / np.where(norms == 0, 1, norms)))

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, run(squeeze(text)))

    return encode


def encode_incremental(
    df: DataFrame, text: str, cache: DataFrame | None, encoder: Encoder, model: str
) -> tuple[DataFrame, DataFrame]:
    """(every row of ``df`` with ``embedding``, the vectors to append to the store).

    Only texts whose (model, text hash) the store lacks are encoded, each distinct text once: the new
    vectors are checkpointed, so what reads either result never runs the encoder again. The join back is on the text hash; copies of one text share a small right-hand row, so a text that
    makes up a third of the table is split by the adaptive skew join.
    """
    hashed = df.withColumn("text_hash", text_hash(text, model))
    distinct = hashed.groupBy("text_hash").agg(F.first(text).alias("_text"))
    if cache is not None:
        known = cache.filter(F.col("model") == model).select("text_hash", "embedding")
        distinct = distinct.join(known, "text_hash", "left_anti")
    fresh = encoder(distinct, "_text", "embedding").select(F.lit(model).alias("model"), "text_hash", "embedding")
    fresh = checkpointed(fresh)
    vectors = fresh.select("text_hash", "embedding")
    if cache is not None:
        vectors = known.unionByName(vectors)
    return hashed.join(vectors, "text_hash").drop("text_hash"), fresh


def check_vectors(vectors: DataFrame, item_id: str, embedding: str, dim: int | None = None) -> None:
    """Refuse duplicate ids and vectors of differing or wrong width: one aggregate, one row back."""
    report = (
        vectors.groupBy(item_id)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.size(embedding)).alias("lo"), F.max(F.size(embedding)).alias("hi"))
        .agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .first()
    )
    if report.n and report.n > 1:
        raise ValueError(f"duplicate {item_id} in the vector table")
    if report.n and (report.lo != report.hi or (dim is not None and report.lo != dim)):
        raise ValueError(f"vectors of width {report.lo} to {report.hi}, expected {dim or 'one width'}")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
