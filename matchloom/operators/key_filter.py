"""Dropping the rows of a large table that no key of a smaller one asks for, before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words of 64 bits: at least 8 KB, at most 2 MB, so the bitmap may be broadcast at any number of keys.
MIN_WORDS = 1 << 10
MAX_WORDS = 1 << 18


def _bit(column: str, words: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(64 * words))


def key_bitmap(keys: DataFrame, column: str, words: int) -> DataFrame:
    """``_place, _mask``: the bits that the keys' hashes set; at most ``words`` rows."""
    at = keys.filter(F.col(column).isNotNull()).select(_bit(column, words).alias("_at"))
    return at.groupBy(F.expr("_at div 64").alias("_place")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_mask")
    )


def possible_rows(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` may stand in ``keys``; all that do are among them.

    A bitmap of 64 bits per distinct key, within ``MIN_WORDS`` and ``MAX_WORDS``, is broadcast and tested where ``df``
    is read. A row without its key passes with a probability of about 1/64; beyond 262,144 keys more pass. An exact
    join has to follow. The bitmap is a semi join: Catalyst would push a later semi join below an inner one. Null keys
    match nothing. ``keys`` is read twice, once to be counted, so it should be cheap to read, for example checkpointed.
    It is cast to the type ``column`` has in ``df``, on which hashes depend.
    """
    kind = df.schema[column].dataType
    distinct = keys.select(F.col(column).cast(kind)).distinct()
    words = min(MAX_WORDS, max(MIN_WORDS, 1 << distinct.count().bit_length()))
    found = df.withColumn("_at", _bit(column, words)).withColumn("_word", F.expr("_at div 64"))
    bit_is_set = F.expr("_word = _place AND shiftright(_mask, cast(_at % 64 as int)) & 1 = 1")
    tested = found.join(F.broadcast(key_bitmap(distinct, column, words)), bit_is_set, "left_semi")
    return tested.filter(F.col(column).isNotNull()).select(*df.columns)
