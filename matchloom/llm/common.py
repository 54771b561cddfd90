"""What the operators share: stored intermediate tables, Arrow output, hold-out buckets."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from matchloom.sources.tables import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
ARROW_ROWS = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the session's shared folder and return the table.

    This cuts the lineage: what reads the result later never runs the plan behind it again, and a lost
    executor costs no recomputation of it.
    """
    spark = df.sparkSession
    path = posixpath.join(shared_folder(spark, "matchloom-llm"), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands texts to Python in batches of at most ``ARROW_ROWS`` rows, unless it asks for fewer."""
    conf = df.sparkSession.conf
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows, "10000")) <= ARROW_ROWS:
        conf.set(rows, str(ARROW_ROWS))
    return df


def crc_bucket(doc_id: str, buckets: int) -> Column:
    """``crc32(doc_id as text) mod buckets``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(buckets)


def below_share(key: Column, share: Column) -> Column:
    """True for that share of the 64-bit hashes ``key``: the smallest ones."""
    return key.cast("double") < F.lit(-(2.0**63)) + share * F.lit(2.0**64)


def hash_sample(df: DataFrame, keys: list[str], n: int, total: int | None = None) -> DataFrame:
    """``n`` rows (all, if there are fewer) of smallest hash of ``keys``; only about ``n`` are ever sorted.

    The number of rows, ``total`` or counted here, tells below which hash they lie. That leaves a fifth and
    100 rows more than needed on average, then the smallest are taken.
    """
    total = df.count() if total is None else total
    key = F.xxhash64(*keys)
    share = F.lit(min(1.0, (1.2 * n + 100) / max(1, total)))
    return df.filter(below_share(key, share)).orderBy(key, *keys).limit(n)


def batches(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def small_batches(source: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that the texts of one hold at most ``max_bytes`` (or are one row)."""
    for batch in source:
        at = 0
        array = batch.column(batch.schema.get_field_index(column))
        while at < batch.num_rows:
            n = batch.num_rows - at
            while n > 1 and array.slice(at, n).nbytes > max_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n
    pa.default_memory_pool().release_unused()  # the worker stays, what it took for the pass should not
