"""Token-bucket audit of an event log.

A bucket holds ``capacity`` tokens and refills over ``window_s`` seconds; an event takes one token or
is denied, and a denial changes nothing. The whole state is the moment at which the bucket will be
full again. Times are integers (microseconds x capacity), so the fold is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Tokens and seconds for anonymous callers, tokens for token holders.
CAPACITY, WINDOW_S = 30, 60
TOKEN_HOLDER_CAPACITY = 120


def fold_bucket(
    ticks: np.ndarray, full_at: int | None, capacity: int, window_us: int
) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Fold events of one key in time order: (allowed, tokens left, new ``full_at``).

    ``ticks`` are microseconds x capacity. Runs of denials are skipped by binary search, so the loop
    takes one step per allowed event or run of denials.
    """
    allowed = np.zeros(len(ticks), dtype=bool)
    tokens = np.zeros(len(ticks))
    limit = (capacity - 1) * window_us
    i = 0
    while i < len(ticks):
        now = int(ticks[i])
        due = now if full_at is None else max(full_at, now)
        if due - now <= limit:
            full_at = due + window_us
            allowed[i] = True
            tokens[i] = capacity - (full_at - now) / window_us
            i += 1
        else:
            until = max(i + 1, int(np.searchsorted(ticks, full_at - limit, side="left")))
            tokens[i:until] = capacity - (full_at - ticks[i:until]) / window_us
            i = until
    return allowed, tokens, full_at


def _with_sessions(events: DataFrame, key: str, window_us: int) -> DataFrame:
    """Add ``_session, _size``. An idle gap of a whole window refills any bucket, so events on its two
    sides are independent. Gaps are found on one summary row per (key, window-long slot)."""
    slots = events.groupBy(key, "_slot").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_low"), F.max("_us").alias("_high")
    )
    by_key = W.partitionBy(key).orderBy("_slot")
    idle = F.coalesce((F.col("_low") - F.lag("_high").over(by_key) >= window_us).cast("int"), F.lit(1))
    numbered = slots.withColumn("_idle", idle).withColumn(
        "_session", F.sum("_idle").over(by_key.rowsBetween(W.unboundedPreceding, 0))
    )
    sized = numbered.withColumn("_size", F.sum("_n").over(W.partitionBy(key, "_session")))
    small = sized.select(F.col(key).alias("_k"), F.col("_slot").alias("_s"), "_session", "_size")
    return events.join(small, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_s"))).drop("_k", "_s")


def token_bucket(
    events: DataFrame,
    key: str,
    ts: str = "ts",
    event_id: str = "event_id",
    capacity: int | str = CAPACITY,
    window_s: int = WINDOW_S,
) -> DataFrame:
    """``events`` with ``allowed`` and ``tokens`` (left after the event).

    ``capacity`` is a number, or the name of a column that holds one number per key, as ``callers``
    gives it. A null key is a key like any other.

    Each key is split at idle gaps into independent sessions. A session of at most ``capacity``
    events never runs dry, so its tokens come from a window expression in the JVM. The others are
    sorted by (key, session, time) and folded batch by batch; the fold carries a single number, so
    no session is ever held in memory.
    """
    window_us = window_s * 1_000_000
    timed = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_slot", F.floor(F.col("_us") / F.lit(window_us))
    )
    tokens_of = F.col(capacity) if isinstance(capacity, str) else F.lit(capacity)
    sessions = _with_sessions(timed, key, window_us).withColumn("_capacity", tokens_of.cast("long"))
    sessions = sessions.withColumn("_tick", F.col("_us") * F.col("_capacity"))
    columns = events.columns

    calm = sessions.filter(F.col("_size") <= F.col("_capacity"))
    in_order = W.partitionBy(key, "_session").orderBy("_us", event_id)
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(in_order)
    start = F.max(F.col("_tick") - (F.col("_place") - 1) * F.lit(window_us)).over(so_far)
    full_at = start + F.col("_place") * F.lit(window_us)
    easy = calm.withColumn("_place", place).select(
        *columns,
        F.lit(True).alias("allowed"),
        (F.col("_capacity").cast("double") - (full_at - F.col("_tick")) / F.lit(window_us)).alias("tokens"),
    )

    busy = sessions.filter(F.col("_size") > F.col("_capacity")).select(*columns, "_session", "_tick", "_capacity")
    ordered = busy.repartition(key, "_session").sortWithinPartitions(key, "_session", "_tick", event_id)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, full_at = None, None
        for frame in frames:
            allowed = np.zeros(len(frame), dtype=bool)
            tokens = np.zeros(len(frame))
            ticks = frame["_tick"].to_numpy()
            codes, keys = pd.factorize(frame[key], use_na_sentinel=False)  # null gets a code too
            sessions_ = frame["_session"].to_numpy()
            capacities = frame["_capacity"].to_numpy()
            changed = (codes[1:] != codes[:-1]) | (sessions_[1:] != sessions_[:-1])
            starts = [0, *(np.flatnonzero(changed) + 1).tolist()] if len(codes) else []
            for lo, hi in zip(starts, [*starts[1:], len(codes)]):
                value = keys[codes[lo]]
                owner = (None if pd.isna(value) else value, sessions_[lo])
                if owner != current:
                    current, full_at = owner, None
                allowed[lo:hi], tokens[lo:hi], full_at = fold_bucket(ticks[lo:hi], full_at, int(capacities[lo]), window_us)
            yield frame[columns].assign(allowed=allowed, tokens=tokens)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    hard = ordered.mapInPandas(run, f"{schema}, allowed boolean, tokens double")
    return easy.unionByName(hard)


def callers(log: DataFrame, token: Column, address: Column) -> DataFrame:
    """``bucket_key, capacity`` per request: by token fingerprint when there is one, else by address."""
    fingerprint = F.concat(F.lit("ratelimit:v1:tok:"), F.substring(F.sha2(token, 256), 1, 16))
    return log.withColumn(
        "bucket_key", F.coalesce(fingerprint, F.concat(F.lit("ratelimit:v1:"), address))
    ).withColumn("capacity", F.when(token.isNotNull(), TOKEN_HOLDER_CAPACITY).otherwise(CAPACITY))
