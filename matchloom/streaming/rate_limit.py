"""Streaming twin of ``token_bucket``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from matchloom.operators.rate_limit import CAPACITY, WINDOW_S, fold_bucket
from matchloom.streaming.ordered_fold import SHARDS, fold_stream

#: windows after a key's last event after which its state goes
IDLE_WINDOWS = 2


def token_bucket_stream(
    events: DataFrame, key: str, delay: str = "10 minutes", capacity: int | str = CAPACITY, window_s: int = WINDOW_S,
    shards: int = SHARDS,
) -> DataFrame:
    """``us, event_id, allowed, tokens, <key>`` for every event; ``events(event_id, ts, <key>)``, a key of any type.

    ``capacity`` is a number or the name of a column that holds one number per key, as ``callers`` gives it. The
    state of a key is one number and its last time. A bucket is full again after one window at most, and a full
    one behaves like a new one: the state goes ``IDLE_WINDOWS`` windows after the last event.
    """
    window_us = window_s * 1_000_000

    def fold(rows: pd.DataFrame, starts: list[int], states: list[tuple | None]) -> tuple[pd.DataFrame, list[tuple]]:
        times, capacities = (rows[c].to_numpy(dtype=np.int64) for c in ("us", "capacity"))
        allowed, tokens, after = np.zeros(len(rows), dtype=bool), np.zeros(len(rows)), []
        for lo, hi, state in zip(starts, starts[1:], states):
            tokens_of = int(capacities[lo])
            allowed[lo:hi], tokens[lo:hi], full_at = fold_bucket(
                times[lo:hi] * tokens_of, state[0] if state else None, tokens_of, window_us
            )
            after.append((int(full_at), int(times[hi - 1])))
        return rows.drop(columns="capacity").assign(allowed=allowed, tokens=tokens), after

    tokens_of = F.col(capacity) if isinstance(capacity, str) else F.lit(capacity)
    timed = events.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).withColumn("capacity", tokens_of.cast("long"))
    return fold_stream(
        timed,
        [key],
        fold,
        ["us", "event_id", "capacity"],
        "full_at long, last_us long",
        "us long, event_id long, allowed boolean, tokens double",
        expires=lambda state: (state[1] + IDLE_WINDOWS * window_us) // 1000 + 1,
        shards=shards,
    )
