"""Streaming twin of ``feedback_actions``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from matchloom.operators.feedback import TARGET, VOTES
from matchloom.streaming.ordered_fold import SHARDS, fold_stream


def toggle(rows: pd.DataFrame, starts: list[int], states: list[tuple | None]) -> tuple[pd.DataFrame, list[tuple]]:
    """State: the vote that is set ('' for none) and whether a click is set."""
    signals = rows["signal"].tolist()
    actions, after = [], []
    for lo, hi, state in zip(starts, starts[1:], states):
        vote, clicked = state or ("", False)
        for signal in signals[lo:hi]:
            if signal in VOTES:
                actions.append("removed" if vote == signal else "created")
                vote = "" if vote == signal else signal
            else:
                actions.append("removed" if clicked else "created")
                clicked = not clicked
        after.append((vote, clicked))
    return rows.assign(action=actions), after


def feedback_stream(events: DataFrame, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """``us, event_id, signal, action`` and the target of every event.

    ``events(event_id, ts, user_id, run_id, job_id, signal)``; the three ids may be of any type. A null
    run is a target of its own.
    """
    return fold_stream(
        events.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")),
        TARGET,
        toggle,
        ["us", "event_id", "signal"],
        "vote string, clicked boolean",
        "us long, event_id long, signal string, action string",
        shards=shards,
    )
