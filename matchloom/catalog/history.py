"""Queries over run history, lists, accounts and feedback.

Customers stand in for users, orders for runs or lists, line items for saved items, events for
feedback.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.catalog.registry import join_text, query, sql_digest, sql_squeeze, table, texts
from matchloom.functions.text import clip_results
from matchloom.operators.feedback import feedback_actions, feedback_state, votes_of_run
from matchloom.operators.filters import live_sessions, purge_sessions
from matchloom.operators.lists import erase_users, list_summary, merge_with_quota
from matchloom.operators.ranking import keep_newest, page_of, quota_overflow
from matchloom.operators.runs import import_runs, run_summary
from matchloom.plans.history import to_runs


@query(
    "history_quota",
    """SELECT o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5""",
)
def history_quota(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return keep_newest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).drop("o_orderdate")


@query(
    "history_dropped",
    "SELECT o_custkey, greatest(count(*) - 5, 0) AS dropped FROM orders GROUP BY o_custkey",
)
def history_dropped(spark, sf):
    return quota_overflow(table(spark, sf, "orders"), ["o_custkey"], 5)


@query(
    "history_page",
    """SELECT o_custkey, o_orderkey, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders) WHERE position BETWEEN 5 AND 8""",
)
def history_page(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return page_of(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2, 4).drop("o_orderdate")


@query(
    "run_summary",
    """WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT l_orderkey AS run_id, CAST(count(*) AS INTEGER) AS result_count, string_agg('part ' || l_partkey, '|' ORDER BY rn) FILTER (WHERE rn <= 3) AS titles
FROM r GROUP BY l_orderkey""",
)
def run_summaries(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("job_id"), "l_suppkey",
            F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("job_title"),
        ).alias("r"),
    )
    runs = items.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list("r")).alias("results"))
    summary = run_summary(runs)
    return summary.select("run_id", "result_count", join_text("top_job_titles").alias("titles"))


@query(
    "persist_runs",
    f"""WITH q AS (SELECT doc_id, doc_id % 20 AS user_id, text, {sql_squeeze('text')} AS flat FROM documents),
l AS (SELECT l_orderkey, count(*) AS n, max(length(substring('item ' || l_shipdate, 1, 12))) AS longest FROM lineitem GROUP BY 1)
SELECT doc_id, user_id, CASE WHEN length(flat) > 50 THEN rtrim(substring(flat, 1, 50)) || '…' ELSE flat END AS label,
  {sql_digest('text')} AS resume_hash, substring(sha256('{{"job_families": null, "min_score": null}}'), 1, 8) AS filters_digest,
  CAST(coalesce(l.n, 0) AS INTEGER) AS result_count, CAST(l.longest AS INTEGER) AS longest FROM q LEFT JOIN l ON l.l_orderkey = q.doc_id
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY doc_id DESC) <= 30""",
)
def persist_runs(spark, sf):
    requests = texts(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), (F.col("doc_id") % 20).alias("user_id"), F.col("text").alias("query_text"),
        F.timestamp_seconds(F.col("doc_id")).alias("created_at"),
    )
    nested = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.struct(
            F.col("l_partkey").alias("job_id"),
            F.concat(F.lit("item "), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("description"),
            F.col("l_linenumber").alias("rank"),
        ).alias("match"),
    )
    runs = to_runs(nested, requests, clip=12, quota=30)
    return runs.select(
        F.unix_seconds("created_at").alias("doc_id"), "user_id", "label", "resume_hash", "filters_digest",
        F.coalesce(F.size("results"), F.lit(0)).alias("result_count"),
        F.array_max(F.transform("results", lambda r: F.length(r["description"]))).alias("longest"),
    ).withColumn("result_count", F.greatest("result_count", F.lit(0)))


_SQL_IMPORT = """
existing AS (SELECT o_custkey AS user_id, o_orderpriority AS resume_hash, CAST(o_orderkey % 2 AS INTEGER) AS top_k, 10 AS top_n, o_orderstatus AS filters_digest,
  o_orderkey AS run_id, o_orderdate AS created_at, 'old' AS label FROM orders WHERE o_orderkey % 3 <> 0),
incoming AS (SELECT o_custkey AS user_id, o_orderpriority AS resume_hash, CAST(o_orderkey % 2 AS INTEGER) AS top_k, 10 AS top_n, o_orderstatus AS filters_digest,
  1000000 + o_orderkey AS run_id, o_orderdate - INTERVAL 400 DAY AS created_at, 'new' AS label, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 <> 1),
first AS (SELECT user_id, resume_hash, top_k, top_n, filters_digest, min(created_at) AS earliest, count(*) AS entries,
  min_by(run_id, seq) AS run_id, min_by(label, seq) AS label FROM incoming GROUP BY 1, 2, 3, 4, 5),
target AS (SELECT user_id, resume_hash, top_k, top_n, filters_digest, max(run_id) AS run_id FROM existing GROUP BY 1, 2, 3, 4, 5),
moved AS (SELECT t.run_id, f.earliest FROM target t JOIN first f USING (user_id, resume_hash, top_k, top_n, filters_digest)),
fresh AS (SELECT f.* FROM first f ANTI JOIN target t USING (user_id, resume_hash, top_k, top_n, filters_digest)),
merged AS (SELECT e.user_id, e.run_id, least(e.created_at, coalesce(m.earliest, e.created_at)) AS created_at, e.label FROM existing e
  LEFT JOIN moved m USING (run_id) UNION ALL SELECT user_id, run_id, earliest, label FROM fresh)"""


def _imported(spark, sf):
    orders = table(spark, sf, "orders")
    key = [
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("resume_hash"),
        (F.col("o_orderkey") % 2).cast("int").alias("top_k"), F.lit(10).alias("top_n"), F.col("o_orderstatus").alias("filters_digest"),
    ]
    existing = orders.filter("o_orderkey % 3 <> 0").select(
        *key, F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.lit("old").alias("label")
    )
    incoming = orders.filter("o_orderkey % 3 <> 1").select(
        *key, (F.lit(1000000) + F.col("o_orderkey")).alias("run_id"),
        (F.col("o_orderdate") - F.expr("INTERVAL 400 DAYS")).alias("created_at"), F.lit("new").alias("label"),
        F.col("o_orderkey").alias("seq"),
    )
    return import_runs(existing, incoming, 8)


@query(
    "import_merge",
    f"""WITH {_SQL_IMPORT} SELECT user_id, run_id, label, CAST(created_at AS VARCHAR) AS created_at FROM merged
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id DESC) <= 8""",
)
def import_merge(spark, sf):
    runs, _ = _imported(spark, sf)
    return runs.select("user_id", "run_id", "label", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(
    "import_counts",
    f"""WITH {_SQL_IMPORT}, n AS (SELECT user_id, count(*) AS imported FROM fresh GROUP BY 1),
e AS (SELECT user_id, sum(entries) AS entries FROM first GROUP BY 1), q AS (SELECT user_id, greatest(count(*) - 8, 0) AS skipped_quota FROM merged GROUP BY 1)
SELECT e.user_id, coalesce(imported, 0) AS imported, CAST(entries - coalesce(imported, 0) AS BIGINT) AS skipped_duplicate, skipped_quota
FROM e LEFT JOIN n USING (user_id) JOIN q USING (user_id)""",
)
def import_counts(spark, sf):
    return _imported(spark, sf)[1]


@query(
    "clip_results",
    """SELECT l_orderkey, string_agg(substring(l_returnflag || l_linestatus || l_linenumber, 1, 2), '|' ORDER BY l_linenumber, l_returnflag || l_linestatus || l_linenumber) AS clipped
FROM lineitem GROUP BY l_orderkey""",
)
def clipped_results(spark, sf):
    entry = F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("description"))
    runs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("results"))
    return runs.select("l_orderkey", join_text(F.transform(clip_results("results", 2), lambda r: r["description"])).alias("clipped"))


# Lists and accounts ------------------------------------------------------------------------------


@query(
    "list_summary",
    """SELECT o.o_custkey AS user_id, o.o_orderkey AS list_id, count(l.l_orderkey) AS item_count FROM orders o
LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2""",
)
def list_summaries(spark, sf):
    lists = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("list_id"))
    items = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("list_id"))
    return list_summary(lists, items)


@query(
    "items_quota",
    """WITH i AS (SELECT l_suppkey AS list_id, l_partkey % 40 AS job_id, l_orderkey, l_linenumber, l_partkey FROM lineitem),
known AS (SELECT DISTINCT list_id, job_id FROM i WHERE l_orderkey % 400 = 0),
calls AS (SELECT * FROM i WHERE l_orderkey % 400 <> 0),
firsts AS (SELECT list_id, job_id, min((l_orderkey, l_linenumber, l_partkey)) AS first_call FROM calls GROUP BY 1, 2),
placed AS (SELECT f.*, row_number() OVER (PARTITION BY list_id ORDER BY first_call) AS place FROM firsts f ANTI JOIN known k USING (list_id, job_id)),
won AS (SELECT p.list_id, p.job_id, first_call FROM placed p LEFT JOIN (SELECT list_id, count(*) AS held FROM known GROUP BY 1) h USING (list_id)
  WHERE place + coalesce(held, 0) <= 25)
SELECT c.list_id, c.job_id, c.l_orderkey, c.l_linenumber, c.l_partkey, CASE WHEN k.job_id IS NOT NULL THEN 'duplicate' WHEN w.first_call IS NULL THEN 'quota'
  WHEN (c.l_orderkey, c.l_linenumber, c.l_partkey) = w.first_call THEN 'created' ELSE 'duplicate' END AS outcome
FROM calls c LEFT JOIN known k USING (list_id, job_id) LEFT JOIN won w USING (list_id, job_id)""",
)
def items_quota(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("list_id"), (F.col("l_partkey") % 40).alias("job_id"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    existing = items.filter("l_orderkey % 400 = 0")
    calls = items.filter("l_orderkey % 400 <> 0")
    return merge_with_quota(existing, calls, ["list_id"], ["job_id"], 25, ["l_orderkey", "l_linenumber", "l_partkey"])


_SQL_KEPT = "c_mktsegment <> 'BUILDING'"


@query(
    "erase_users",
    f"""WITH u AS (SELECT * FROM customer WHERE {_SQL_KEPT}), r AS (SELECT o.* FROM orders o JOIN u ON u.c_custkey = o.o_custkey),
gone AS (SELECT c_custkey FROM customer WHERE NOT {_SQL_KEPT}), lost AS (SELECT o_orderkey FROM orders JOIN gone ON c_custkey = o_custkey)
SELECT 'users' AS name, count(*) AS n FROM u UNION ALL SELECT 'runs', count(*) FROM r
UNION ALL SELECT 'lists', count(*) FROM r
UNION ALL SELECT 'items', count(*) FROM lineitem l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost)
UNION ALL SELECT 'feedback', count(*) FROM events e WHERE user_id NOT IN (SELECT c_custkey FROM gone) AND event_id NOT IN (SELECT o_orderkey FROM lost)
UNION ALL SELECT 'sessions', count(*) FROM events e WHERE user_id NOT IN (SELECT c_custkey FROM gone)""",
)
def erased_users(spark, sf):
    customer = table(spark, sf, "customer")
    users = customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("run_id"))
    events = table(spark, sf, "events")
    tables = {
        "users": users,
        "runs": orders,
        "lists": orders.withColumnRenamed("run_id", "list_id"),
        "items": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("list_id")),
        "feedback": events.select("user_id", F.col("event_id").alias("run_id")),
        "sessions": events.select("user_id"),
    }
    kept = erase_users(tables, users.filter("c_mktsegment = 'BUILDING'"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in kept.items()]
    result = counts[0]
    for df in counts[1:]:
        result = result.unionByName(df)
    return result


_SQL_SESSIONS = """s AS (SELECT event_id, user_id, ts AS created_at, ts + INTERVAL 14 DAY AS expires_at,
  CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 DAY END AS revoked_at FROM events)"""


def _sessions(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", "user_id", ts.alias("created_at"), (ts + F.expr("INTERVAL 14 DAYS")).alias("expires_at"),
        F.when(F.col("event_type") == "error", ts + F.expr("INTERVAL 1 DAY")).alias("revoked_at"),
    )


def _at(text):
    return F.to_timestamp(F.lit(text))


@query(
    "purge_sessions",
    f"""WITH {_SQL_SESSIONS} SELECT event_id FROM s WHERE NOT (expires_at <= TIMESTAMP '2024-01-29'
  OR coalesce(revoked_at < TIMESTAMP '2024-01-20', false))""",
)
def purged_sessions(spark, sf):
    return purge_sessions(_sessions(spark, sf), _at("2024-01-29 00:00:00"), _at("2024-01-20 00:00:00")).select("event_id")


@query(
    "live_sessions",
    f"""WITH {_SQL_SESSIONS} SELECT event_id, user_id FROM s JOIN customer ON c_custkey = user_id
WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '2024-01-29' AND c_acctbal > 2000""",
)
def live_sessions_events(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 2000).alias("is_active"))
    return live_sessions(_sessions(spark, sf), users, _at("2024-01-29 00:00:00")).select("event_id", "user_id")


@query(
    "session_cap",
    """SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""",
)
def session_cap(spark, sf):
    sessions = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return keep_newest(sessions, ["user_id"], ["ts", "event_id"], 10).drop("ts")


# Feedback ----------------------------------------------------------------------------------------

_SQL_SIGNALS = """e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 4 > 0 THEN user_id % 5 END AS run_id,
  CAST(props->>'$.k' AS BIGINT) % 4 AS job_id, CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' ELSE 'click' END AS signal
  FROM events WHERE event_type IN ('purchase', 'error', 'click')),
k AS (SELECT *, coalesce(run_id, -1) AS r, signal = 'click' AS lane FROM e),
c AS (SELECT *, coalesce(lag(signal) OVER w <> signal, false)::INT AS turned FROM k WINDOW w AS (PARTITION BY user_id, r, job_id, lane ORDER BY ts, event_id)),
i AS (SELECT *, sum(turned) OVER (PARTITION BY user_id, r, job_id, lane ORDER BY ts, event_id) AS island FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, r, job_id, lane, island ORDER BY ts, event_id) AS place,
  max(island) OVER (PARTITION BY user_id, r, job_id, lane) AS last_island,
  count(*) OVER (PARTITION BY user_id, r, job_id, lane, island) AS size FROM i)"""


def signals(events):
    """Feedback calls from the event table: purchase is up, error is down, click is click."""
    signal = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise("click")
    return events.filter(F.col("event_type").isin("purchase", "error", "click")).select(
        "event_id", "ts", "user_id", F.when(F.col("event_id") % 4 > 0, F.col("user_id") % 5).alias("run_id"),
        (F.get_json_object("props", "$.k").cast("long") % 4).alias("job_id"), signal.alias("signal"),
    )


@query(
    "feedback_actions",
    f"WITH {_SQL_SIGNALS} SELECT event_id, signal, CASE WHEN place % 2 = 1 THEN 'created' ELSE 'removed' END AS action FROM p",
)
def feedback_action_log(spark, sf):
    return feedback_actions(signals(table(spark, sf, "events")), 86_400).select("event_id", "signal", "action")


@query(
    "feedback_state",
    f"""WITH {_SQL_SIGNALS} SELECT DISTINCT user_id, run_id, job_id, signal FROM p
WHERE island = last_island AND size % 2 = 1""",
)
def feedback_states(spark, sf):
    return feedback_state(signals(table(spark, sf, "events")))


@query(
    "feedback_votes",
    f"""WITH {_SQL_SIGNALS} SELECT DISTINCT user_id, run_id, job_id, signal FROM p
WHERE island = last_island AND size % 2 = 1 AND signal <> 'click' AND run_id IS NOT NULL""",
)
def feedback_votes(spark, sf):
    return votes_of_run(feedback_state(signals(table(spark, sf, "events"))))
