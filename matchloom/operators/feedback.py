"""Feedback events folded into actions and state.

Posting the same signal again removes it; ``up`` and ``down`` exclude each other; ``click`` only
toggles itself. So within one (user, run, job) the votes form islands of equal signals, and a vote is
a creation when its place in its island is odd. Clicks are one island.

An island may be long, and one target may hold a third of all events. Places are therefore counted
per time chunk first: the windows over events are keyed by (target, chunk), and only one summary row
per chunk is windowed per target to find what each chunk inherits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

TARGET = ["user_id", "run_id", "job_id"]
VOTES = ("up", "down")


def feedback_actions(events: DataFrame, chunk_seconds: int = 3600, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``events`` with ``action``: created or removed.

    ``events(user_id, run_id, job_id, signal, ts, ...)``; a null run is a target of its own.
    """
    lane = F.when(F.col("signal").isin(*VOTES), "vote").otherwise(F.col("signal"))
    chunked = events.withColumn("_lane", lane).withColumn(
        "_chunk", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(chunk_seconds * 1_000_000))
    )
    keys = [*TARGET, "_lane"]
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    changed = F.coalesce((F.lag("signal").over(inside) != F.col("signal")).cast("int"), F.lit(0))
    islands = chunked.withColumn("_changed", changed).withColumn("_island", F.sum("_changed").over(so_far))
    island = W.partitionBy(*keys, "_chunk", "_island").orderBy(*order)
    placed = islands.withColumn("_place", F.row_number().over(island))

    chunks = placed.groupBy(*keys, "_chunk").agg(
        F.min_by("signal", F.struct("_island", "_place")).alias("_first"),
        F.max_by("signal", F.struct("_island", "_place")).alias("_last"),
        F.max_by("_place", F.struct("_island", "_place")).alias("_tail"),
        F.max("_island").alias("_islands"),
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk")
    running = earlier.rowsBetween(W.unboundedPreceding, 0)
    # a chunk continues the tail before it only when it is one island of the same signal
    breaks = (F.col("_islands") > 0) | ~F.lag("_last").over(earlier).eqNullSafe(F.col("_first"))
    tails = (
        chunks.withColumn("_break", breaks.cast("int"))
        .withColumn("_run", F.sum("_break").over(running))
        .withColumn("_length", F.sum("_tail").over(W.partitionBy(*keys, "_run").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_carry", F.when(F.lag("_last").over(earlier) == F.col("_first"), F.lag("_length").over(earlier)))
        .select(*[F.col(k).alias(f"_t{k}") for k in [*keys, "_chunk"]], F.coalesce("_carry", F.lit(0)).alias("_carry"))
    )
    same = F.lit(True)
    for k in [*keys, "_chunk"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_t{k}"))
    place = F.col("_place") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(F.lit(0))
    return placed.join(tails, same).withColumn(
        "action", F.when(place % 2 == 1, "created").otherwise("removed")
    ).select(*events.columns, "action")


def feedback_state(
    events: DataFrame, chunk_seconds: int = 3600, order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """``user_id, run_id, job_id, signal``: the signals that are set at the end.

    The last vote, and the last click, of a target is set when its action was a creation. The maximum
    combines map-side; a join of the events with their target would not, and could not be split for
    a hot target either, since the aggregation after it has the same key.
    """
    vote = F.col("signal").isin(*VOTES)
    return (
        feedback_actions(events, chunk_seconds, order)
        .groupBy(*TARGET, F.when(~vote, F.col("signal")).alias("_lane"))
        .agg(F.max_by(F.struct("signal", "action"), F.struct(*order)).alias("_last"))
        .filter(F.col("_last.action") == "created")
        .select(*TARGET, F.col("_last.signal").alias("signal"))
    )


def votes_of_run(state: DataFrame) -> DataFrame:
    """What a result list shows as set: votes only, and only those that belong to a run."""
    return state.filter(F.col("signal").isin(*VOTES) & F.col("run_id").isNotNull())
