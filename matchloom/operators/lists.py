"""Saved lists: summaries, quota merges, account erasure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.ranking import top_n

# Lists per user and items per list.
LIST_QUOTA = 50
ITEM_QUOTA = 200


def list_summary(lists: DataFrame, items: DataFrame, key: str = "list_id") -> DataFrame:
    """Every list with its ``item_count`` (0 when empty). Order by user and ``created_at`` to show."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("item_count"))
    return lists.join(counts, key, "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def merge_with_quota(
    existing: DataFrame, incoming: DataFrame, by: Sequence[str], key: Sequence[str], quota: int, order: Sequence[str]
) -> DataFrame:
    """``incoming`` with ``outcome``: created, duplicate or quota.

    Rows arrive in ``order``. A key the owner already has, or had created earlier in the batch, is a
    duplicate; a new key is created while the owner has fewer than ``quota`` keys and rejected after.

    Only first arrivals compete for places, and at most ``quota`` of them per owner can win, so each
    owner is cut to that many rows before the shuffle: a hot owner does not gather in one task.
    """
    own, full = list(by), [*by, *key]
    arrivals = incoming.groupBy(*full).agg(F.min(F.struct(*order)).alias("_first"))
    known = existing.select(*full).distinct()
    held = known.groupBy(*own).agg(F.count(F.lit(1)).alias("_held"))
    new = arrivals.join(known, full, "left_anti")
    front = top_n(new, own, [F.asc("_first")], quota, "_place")
    winners = (
        front.join(held, own, "left")
        .filter(F.col("_place") + F.coalesce("_held", F.lit(0)) <= quota)
        .select(*full, F.col("_first").alias("_won"))
    )
    marked = known.select(*full, F.lit(True).alias("_known"))
    outcome = (
        F.when(F.col("_known"), "duplicate")
        .when(F.col("_won").isNull(), "quota")
        .when(F.struct(*order) == F.col("_won"), "created")
        .otherwise("duplicate")
    )
    return (
        incoming.join(winners, full, "left")
        .join(marked, full, "left")
        .withColumn("outcome", outcome)
        .drop("_won", "_known")
    )


def erase_users(tables: Mapping[str, DataFrame], users: DataFrame, key: str = "user_id") -> dict[str, DataFrame]:
    """Remove users and everything that hangs on them.

    ``tables`` may hold users, sessions, runs, feedback, lists and items. Feedback goes by user and by
    run, items go with their list.
    """
    gone = users.select(key).distinct()
    kept: dict[str, DataFrame] = {}
    for name, table in tables.items():
        kept[name] = table.join(gone, key, "left_anti") if key in table.columns else table
    if "runs" in tables and "feedback" in tables:
        lost = tables["runs"].join(gone, key, "left_semi").select("run_id").distinct()
        kept["feedback"] = kept["feedback"].join(lost, "run_id", "left_anti")
    if "lists" in tables and "items" in tables:
        lost = tables["lists"].join(gone, key, "left_semi").select("list_id").distinct()
        kept["items"] = kept["items"].join(lost, "list_id", "left_anti")
    return kept


def duplicate_emails(users: DataFrame, email: Column) -> DataFrame:
    """``email_key, n`` for identities used more than once."""
    return users.groupBy(email.alias("email_key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
