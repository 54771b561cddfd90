"""Ranks, keep-first, keep-newest, pages and positions.

``row_number() <= literal`` lets Spark cut every group to that many rows *before* the shuffle
(WindowGroupLimit), so a hot key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

_RANK = "_rank_in_group"


def _newest(order: Sequence[Column | str]) -> list[Column]:
    return [F.desc(c) if isinstance(c, str) else c for c in order]


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``name`` keeps the 1-based rank."""
    ranked = df.withColumn(name or _RANK, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col(name or _RANK) <= n)
    return kept if name else kept.drop(_RANK)


def rank_by(
    df: DataFrame, score: str, ties: Sequence[str], by: Sequence[str] = ("query_id",),
    name: str = "retrieval_rank", limit: int | None = None,
) -> DataFrame:
    """1-based rank by score descending, ties by ``ties`` ascending. Shortlists are small; give
    ``limit`` when they are not."""
    order = [F.desc(score), *[F.asc(t) for t in ties]]
    if limit is not None:
        return top_n(df, by, order, limit, name)
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` (``dropDuplicates`` would pick any)."""
    return top_n(df, keys, [F.asc(o) for o in order], 1)


def keep_newest(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """Rolling window: the newest ``n`` rows of each group; older rows go silently."""
    return top_n(df, by, _newest(order), n)


def quota_overflow(df: DataFrame, by: Sequence[str], n: int, name: str = "dropped") -> DataFrame:
    """How many rows ``keep_newest`` drops per group."""
    return df.groupBy(*by).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias(name))


def page_of(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], page: int, size: int = 20) -> DataFrame:
    """Page ``page`` (from 1) of each group, newest first; ``position`` is the rank in the group."""
    first = (page - 1) * size
    return top_n(df, by, _newest(order), first + size, "position").filter(F.col("position") > first)


def rank_delta(df: DataFrame, retrieval: str = "retrieval_rank", final: str = "rank") -> DataFrame:
    """Places won (positive) or lost by reranking."""
    return df.withColumn("rank_delta", F.col(retrieval) - F.col(final))


# Sort modes of a result list and the score each one uses.
SORT_MODES = {
    "relevance": "cross_encoder_probability",
    "semantic": "bi_encoder",
    "skill_coverage": "skill_overlap",
}


def sort_results(
    df: DataFrame, mode: str, by: Sequence[str] = ("query_id",), rank: str = "rank", scores: str | None = None
) -> DataFrame:
    """Add ``position``: the place of each result under the chosen sort, ties in ``rank`` order.
    ``scores`` names a struct column that holds the score fields."""
    field = f"{scores}.{SORT_MODES[mode]}" if scores else SORT_MODES[mode]
    return df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(field), F.asc(rank))))


def hash_order(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def with_hash_position(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    seed: int = 42,
    name: str = "position",
    bits: int = 10,
) -> DataFrame:
    """Dense 1-based position of every row within ``by``, in seeded pseudo-random order of ``keys``.

    The order is (hash, keys). Rows are bucketed by the top ``bits`` of the hash, so buckets are in
    hash order; a position is the size of the earlier buckets plus the rank inside the bucket. Only
    the bucket counts are windowed per group (at most ``2**bits`` rows), hence a group holding most
    rows, or no grouping at all, still ranks in ``2**bits`` independent pieces. The result does not
    depend on how the input is partitioned.
    """
    hashed = df.withColumn("_hash", hash_order(keys, seed)).withColumn(
        "_bucket", F.shiftright("_hash", 64 - bits)
    )
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_offset", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
        .drop("_count")
    )
    for column in (*by, "_bucket"):
        offsets = offsets.withColumnRenamed(column, f"_o_{column}")
    same = F.lit(True)
    for column in (*by, "_bucket"):
        same = same & F.col(column).eqNullSafe(F.col(f"_o_{column}"))
    inside = W.partitionBy(*by, "_bucket").orderBy("_hash", *keys)
    return (
        hashed.join(offsets, same)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_hash", "_bucket", "_offset", *[f"_o_{c}" for c in (*by, "_bucket")])
    )


# Columns a source may add to say where a row was read: file, and the first byte of its block.
FILE_PLACE = ("_file", "_block")


def with_file_place(df: DataFrame) -> DataFrame:
    """Add ``_file, _block`` to a plain scan of files (read, select, filter); other frames stay as they are."""
    if set(FILE_PLACE) <= set(df.columns) or "_metadata" in df.columns:
        return df
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    try:
        return df.select("*", path.alias(FILE_PLACE[0]), block.alias(FILE_PLACE[1]))
    except AnalysisException:  # not a scan of files
        return df


def with_ingest_order(df: DataFrame, name: str = "ingest_ord") -> DataFrame:
    """Dense 1-based ids in file order, JVM-side and without a single-task window over rows.

    Files count in the order of their paths, rows in their order in the file, whatever the splits Spark packs into a
    task. The id is the row's place in its block plus the rows of the earlier blocks; only the table of blocks (file,
    first byte, rows) is windowed. ``df`` is a plain scan (read, select, filter) or carries ``_file, _block``, which
    are dropped; any other frame counts in the order of its partitions.
    """
    placed = with_file_place(df)
    marked = placed.withColumn("_mono", F.monotonically_increasing_id())
    if not set(FILE_PLACE) <= set(placed.columns):
        part = F.shiftright("_mono", 33)
        marked = marked.withColumn("_file", F.lit("")).withColumn("_block", part)
    earlier = W.orderBy("_in", "_at").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        marked.groupBy(F.col("_file").alias("_in"), F.col("_block").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_mono").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    return (
        marked.join(blocks, (F.col("_file") == F.col("_in")) & (F.col("_block") == F.col("_at")))
        .withColumn(name, F.col("_offset") + F.col("_mono") - F.col("_first") + 1)
        .drop("_mono", "_file", "_block", "_in", "_at", "_first", "_offset")
    )


def with_dense_id(df: DataFrame, name: str) -> DataFrame:
    """Ids 1..n in file order for a table that came without an id column."""
    return df if name in df.columns else with_ingest_order(df, name)
