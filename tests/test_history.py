import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from matchloom.operators.feedback import feedback_actions, feedback_state, votes_of_run
from matchloom.operators.filters import live_sessions, purge_sessions
from matchloom.operators.lists import erase_users, list_summary, merge_with_quota
from matchloom.operators.ranking import keep_newest
from matchloom.operators.runs import compare_runs, import_runs, run_summary
from matchloom.plans.history import to_runs

T0 = datetime(2024, 1, 1)


def simulate(events):
    """Apply feedback calls one by one to a set of stored rows."""
    stored, actions = set(), {}
    for event_id, _, user, run, job, signal in sorted(events, key=lambda e: (e[1], e[0])):
        key, other = (user, run, job, signal), {"up": "down", "down": "up"}.get(signal)
        if key in stored:
            stored.remove(key)
            actions[event_id] = "removed"
        else:
            stored.discard((user, run, job, other))
            stored.add(key)
            actions[event_id] = "created"
    return actions, stored


def events(n, users, spread_s, seed):
    rng = random.Random(seed)
    return [
        (i, T0 + timedelta(seconds=rng.randrange(spread_s)), rng.randrange(users), rng.choice([None, 1, 2]), rng.randrange(3),
         rng.choice(["up", "up", "down", "click"]))
        for i in range(n)
    ]


SCHEMA = "event_id long, ts timestamp, user_id long, run_id long, job_id long, signal string"


@pytest.mark.parametrize("n, users, spread, chunk", [(800, 2, 50_000, 3600), (500, 1, 200, 7), (600, 40, 100_000, 86_400), (300, 1, 10, 3600)])
def test_feedback_equals_simulation(spark, n, users, spread, chunk):
    calls = events(n, users, spread, n)
    actions, stored = simulate(calls)
    df = spark.createDataFrame(calls, SCHEMA)
    assert dict(rows(feedback_actions(df, chunk).select("event_id", "action"))) == actions
    state = feedback_state(df)
    assert {tuple(r) for r in state.collect()} == stored
    assert {tuple(r) for r in votes_of_run(state).collect()} == {s for s in stored if s[3] != "click" and s[1] is not None}


def test_feedback_known_answers(spark):
    def state(*signals):
        df = spark.createDataFrame([(i, T0 + timedelta(seconds=i), 1, 1, 1, s) for i, s in enumerate(signals)], SCHEMA)
        return sorted(r.signal for r in feedback_state(df).collect())

    assert state("up", "up") == [] and state("down", "up", "down") == ["down"] and state("up", "click", "down") == ["click", "down"]


RUN = "run_id long, user_id long, resume_hash string, top_k int, top_n int, filters_digest string, created_at timestamp, label string"


def at(day):
    return T0 + timedelta(days=day)


def test_import_merge(spark):
    existing = spark.createDataFrame([(1, 1, "h1", 30, 10, "f", at(5), "kept"), (2, 1, "h1", 30, 10, "f", at(6), "twin")], RUN)
    incoming = spark.createDataFrame(
        [(10, 1, "h1", 30, 10, "f", at(1), "dup", 0), (11, 1, "h2", 30, 10, "f", at(9), "first", 1),
         (12, 1, "h2", 30, 10, "f", at(2), "later", 2), (13, 2, "h1", 30, 10, "f", at(3), "other user", 3)],
        RUN + ", seq int",
    )
    runs, counts = import_runs(existing, incoming)
    assert sorted((r.run_id, r.label, r.created_at) for r in runs.collect()) == [
        (1, "kept", at(5)), (2, "twin", at(1)), (11, "first", at(2)), (13, "other user", at(3))
    ]
    assert rows(counts) == [(1, 1, 2, 0), (2, 1, 0, 0)]
    again, counts = import_runs(runs, incoming)
    assert rows(again.select("run_id", "created_at")) == rows(runs.select("run_id", "created_at"))
    assert rows(counts) == [(1, 0, 3, 0), (2, 0, 1, 0)]


def test_import_quota(spark):
    none = spark.createDataFrame([], RUN)
    incoming = spark.createDataFrame([(i, 1, f"h{i}", 30, 10, "f", at(i), "x", i) for i in range(5)], RUN + ", seq int")
    runs, counts = import_runs(none, incoming, quota=2)
    assert sorted(r.run_id for r in runs.collect()) == [3, 4] and rows(counts) == [(1, 5, 0, 3)]


def test_persist_summarise_compare(spark):
    explanation = "struct<matched_skills:array<string>>"
    nested = spark.createDataFrame(
        [(1, (7, "Nurse", "d" * 500, 2, (["icu"],))), (1, (8, "Chef", "d", 1, (["sql", "icu"],))), (2, (8, "Chef", "d", 1, (["git"],)))],
        f"query_id long, match struct<job_id:bigint, job_title:string, description:string, rank:int, explanation:{explanation}>",
    )
    requests = spark.createDataFrame([(1, 5, "a " * 60, at(1)), (2, 5, "b", at(2)), (3, 5, "c", at(0))], "query_id long, user_id long, query_text string, created_at timestamp")
    runs = to_runs(nested, requests, quota=2).cache()
    got = {r.resume_text: r for r in runs.collect()}
    assert set(got) == {"a " * 60, "b"}  # the oldest of three goes
    first = got["a " * 60]
    assert [r.job_id for r in first.results] == [8, 7] and len(first.results[1].description) == 400
    assert first.label == ("a " * 25).rstrip() + "…" and len(first.run_id) == 32
    summary = {r.label: (r.result_count, r.top_job_titles) for r in run_summary(runs).collect()}
    assert summary["b"] == (1, ["Chef"]) and "results" not in run_summary(runs).columns
    moved, skills, corpora = compare_runs(runs, first.run_id, got["b"].run_id)
    assert [(r.job_id, r.rank_a, r.rank_b, r.movement) for r in moved.collect()] == [(8, 1, 1, 0)]
    assert sorted((r.side, r.skill) for r in skills.collect()) == [("A", "icu"), ("A", "sql"), ("B", "git")]
    assert corpora.first().corpora_differ is False


def test_history_quota(spark):
    runs = spark.createDataFrame([(i, 1, at(i)) for i in range(5)], "run_id long, user_id long, created_at timestamp")
    assert sorted(r.run_id for r in keep_newest(runs, ["user_id"], ["created_at", "run_id"], 3).collect()) == [2, 3, 4]


def add_items(existing, calls, quota):
    held, out = defaultdict(set), []
    for owner, key in existing:
        held[owner].add(key)
    for owner, key, order in sorted(calls, key=lambda c: c[2]):
        if key in held[owner]:
            out.append((owner, key, order, "duplicate"))
        elif len(held[owner]) >= quota:
            out.append((owner, key, order, "quota"))
        else:
            held[owner].add(key)
            out.append((owner, key, order, "created"))
    return sorted(out)


@pytest.mark.parametrize("quota", [1, 4, 9])
def test_quota_merge_equals_simulation(spark, quota):
    rng = random.Random(quota)
    existing = [(o, k) for o in range(3) for k in range(o * 2)]
    calls = [(rng.choice([0, 0, 1, 2]), rng.randrange(12), i) for i in range(200)]
    got = merge_with_quota(
        spark.createDataFrame(existing, "list_id int, job_id int"), spark.createDataFrame(calls, "list_id int, job_id int, seq int"),
        ["list_id"], ["job_id"], quota, ["seq"],
    )
    assert sorted((r.list_id, r.job_id, r.seq, r.outcome) for r in got.collect()) == add_items(existing, calls, quota)


def test_list_summary(spark):
    lists = spark.createDataFrame([(1, "a"), (2, "b")], "list_id int, name string")
    items = spark.createDataFrame([(1,), (1,)], "list_id int")
    assert rows(list_summary(lists, items)) == [(1, "a", 2), (2, "b", 0)]


def test_erase_cascade(spark):
    ids = lambda *r: spark.createDataFrame(list(r), "user_id long, run_id long")
    tables = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id long"),
        "sessions": spark.createDataFrame([(1,), (2,)], "user_id long"),
        "runs": ids((1, 10), (2, 20)),
        "feedback": ids((2, 10), (2, 20), (1, 20), (2, None)),
        "lists": spark.createDataFrame([(1, 5), (2, 6)], "user_id long, list_id long"),
        "items": spark.createDataFrame([(5, 1), (6, 1)], "list_id long, job_id long"),
    }
    kept = erase_users(tables, spark.createDataFrame([(1,)], "user_id long"))
    assert {name: df.count() for name, df in kept.items()} == {"users": 1, "sessions": 1, "runs": 1, "feedback": 2, "lists": 1, "items": 1}
    assert kept["items"].first().list_id == 6


def test_sessions(spark):
    now = at(100)
    data = [(1, 1, at(99), None), (2, 1, at(120), at(40)), (3, 1, at(120), at(99)), (4, 1, at(120), None), (5, 2, at(120), None), (6, 1, now, None)]
    sessions = spark.createDataFrame(data, "session_id int, user_id int, expires_at timestamp, revoked_at timestamp")
    kept = purge_sessions(sessions, F.lit(now), F.lit(now - timedelta(days=30)))
    assert sorted(r.session_id for r in kept.collect()) == [3, 4, 5]
    users = spark.createDataFrame([(1, True), (2, False)], "user_id int, is_active boolean")
    assert [r.session_id for r in live_sessions(sessions, users, F.lit(now)).collect()] == [4]
