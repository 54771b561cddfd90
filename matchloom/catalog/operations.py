"""Queries over request checks, latency, rate limits and the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.catalog.history import _SQL_SIGNALS, signals
from matchloom.catalog.registry import join_text, query, r6, table, texts
from matchloom.operators.filters import request_problems, validate_requests
from matchloom.operators.latency import latency_windows
from matchloom.operators.metrics import latency_percentiles
from matchloom.operators.rate_limit import callers, token_bucket
from matchloom.sources.tables import shared_folder
from matchloom.streaming.feedback import feedback_stream
from matchloom.streaming.latency import latency_stream
from matchloom.streaming.rate_limit import token_bucket_stream

_SQL_REQUESTS = """r AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 201 ELSE 30 END AS top_k,
  CASE WHEN doc_id % 7 = 0 THEN 51 ELSE 10 END AS top_n, CASE doc_id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 END AS min_score FROM documents),
c AS (SELECT doc_id, list_filter([CASE WHEN length(text) < 40 THEN 'resume_text too short' END, CASE WHEN length(text) > 20000 THEN 'resume_text too long' END,
  CASE WHEN NOT top_k BETWEEN 1 AND 200 THEN 'top_k out of range' END, CASE WHEN NOT top_n BETWEEN 1 AND 50 THEN 'top_n out of range' END,
  CASE WHEN NOT min_score BETWEEN 0 AND 1 THEN 'min_score out of range' END], lambda x: x IS NOT NULL) AS reasons FROM r)"""


def _requests(spark, sf):
    d = F.col("doc_id")
    return texts(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("resume_text"),
        F.when(d % 11 == 0, 0).when(d % 13 == 0, 201).otherwise(30).alias("top_k"),
        F.when(d % 7 == 0, 51).otherwise(10).alias("top_n"),
        F.when(d % 5 == 0, 1.5).when(d % 5 == 1, 0.5).alias("min_score"),
    )


@query("quarantine_requests", f"WITH {_SQL_REQUESTS} SELECT doc_id, array_to_string(reasons, '|') AS reasons FROM c")
def quarantine_requests(spark, sf):
    return request_problems(_requests(spark, sf)).select("doc_id", join_text("reasons").alias("reasons"))


@query("valid_requests", f"WITH {_SQL_REQUESTS} SELECT doc_id FROM c WHERE len(reasons) = 0")
def valid_requests(spark, sf):
    return validate_requests(_requests(spark, sf))[0].select("doc_id")


def _sql_points(value: str) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), 6) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))


@query("latency_percentiles", f"SELECT event_type, {_sql_points('value::DOUBLE')} FROM events GROUP BY event_type")
def latency_by_type(spark, sf):
    found = latency_percentiles(table(spark, sf, "events"), "value", ["event_type"])
    return found.select("event_type", *[r6(p).alias(p) for p in ("p50", "p95", "p99")])


@query("latency_long_tail", f"SELECT event_type, {_sql_points('exp(value::DOUBLE / 100)')} FROM events GROUP BY event_type")
def latency_long_tail(spark, sf):
    """Values whose range is mostly tail: buckets of equal width would hold nearly all of them in one."""
    events = table(spark, sf, "events").select("event_type", F.exp(F.col("value") / 100).alias("v"))
    found = latency_percentiles(events, "v", ["event_type"])
    return found.select("event_type", *[r6(p).alias(p) for p in ("p50", "p95", "p99")])


_GAMMA = "(1.01::DOUBLE / 0.99::DOUBLE)"


def _sql_bucket_points(keys: str, source: str) -> str:
    """p50, p95 and p99 by ``keys`` from counts in logarithmic buckets of ``v``, in ``source``."""
    found = ", ".join(
        f"round(min(CASE WHEN seen > floor({p}::DOUBLE * (total - 1)) THEN CASE WHEN b IS NULL THEN 0 ELSE 2 * pow({_GAMMA}, b) / ({_GAMMA} + 1) END END), 6) AS {n}"
        for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    )
    return f"""SELECT {keys}, {found} FROM (
  SELECT {keys}, b, sum(n) OVER (PARTITION BY {keys} ORDER BY b NULLS FIRST) AS seen, sum(n) OVER (PARTITION BY {keys}) AS total FROM (
    SELECT {keys}, CASE WHEN v > 0 THEN ceil(ln(v) / ln({_GAMMA})) END AS b, count(*) AS n FROM ({source}) WHERE v IS NOT NULL GROUP BY ALL)) GROUP BY ALL"""


@query("latency_sketch", _sql_bucket_points("event_type", "SELECT event_type, value::DOUBLE AS v FROM events"))
def latency_by_type_sketch(spark, sf):
    found = latency_percentiles(table(spark, sf, "events"), "value", ["event_type"], exact=False)
    return found.select("event_type", *[r6(p).alias(p) for p in ("p50", "p95", "p99")])


def _log(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), F.col("value").alias("took_ms"),
        F.when(F.col("event_id") % 9 == 0, 503).otherwise(200).alias("status"),
    )


_SQL_WINDOWS = """date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6) AS start, event_type AS path, count(*) AS requests,
  count(*) FILTER (WHERE event_id % 9 = 0) AS errors"""


@query(
    "windowed_latency",
    f"""SELECT CAST(start AS VARCHAR) AS start, path, requests, errors, round(errors / requests, 6) AS error_rate, p50, p95, p99 FROM (
SELECT {_SQL_WINDOWS}, {_sql_points('value::DOUBLE')} FROM events GROUP BY 1, 2)""",
)
def windowed_latency(spark, sf):
    windows = latency_windows(_log(table(spark, sf, "events")), "6 hours")
    return windows.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "path", "requests", "errors",
        *[r6(c).alias(c) for c in ("error_rate", "p50", "p95", "p99")],
    )


# A bucket of 3 tokens that refills in two days, so that the sparse test events run it dry.
_BUCKET, _WINDOW_S = 3, 172_800
_SQL_BUCKET = f"""RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) * {_BUCKET} AS tick,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, tick, true AS allowed, tick + {_WINDOW_S}000000 AS full_at FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, e.tick, greatest(f.full_at, e.tick) - e.tick <= {(_BUCKET - 1) * _WINDOW_S}000000,
  CASE WHEN greatest(f.full_at, e.tick) - e.tick <= {(_BUCKET - 1) * _WINDOW_S}000000 THEN greatest(f.full_at, e.tick) + {_WINDOW_S}000000 ELSE f.full_at END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)"""
_SQL_TOKENS = f"round({_BUCKET}::DOUBLE - (full_at - tick) / {_WINDOW_S}000000.0::DOUBLE, 6)"


@query("token_bucket", f"WITH {_SQL_BUCKET} SELECT event_id, user_id, allowed, {_SQL_TOKENS} AS tokens FROM f")
def token_bucket_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return token_bucket(events, "user_id", capacity=_BUCKET, window_s=_WINDOW_S).select(
        "event_id", "user_id", "allowed", r6("tokens").alias("tokens")
    )


@query(
    "rate_limit_keys",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN concat('ratelimit:v1:tok:', substring(sha256(user_id::VARCHAR), 1, 16))
  ELSE concat('ratelimit:v1:', event_type) END AS bucket_key, CASE WHEN user_id % 2 = 0 THEN 120 ELSE 30 END AS capacity FROM events""",
)
def rate_limit_keys(spark, sf):
    token = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))
    return callers(table(spark, sf, "events"), token, F.col("event_type")).select("event_id", "bucket_key", "capacity")


_LIMIT_WINDOW_S = 7_776_000
_SQL_LIMITED = f"""RECURSIVE k AS (SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN concat('ratelimit:v1:tok:', substring(sha256(user_id::VARCHAR), 1, 16))
  ELSE concat('ratelimit:v1:', event_type, user_id % 40) END AS bucket_key, CASE WHEN user_id % 2 = 0 THEN 120 ELSE 30 END AS capacity FROM events),
e AS (SELECT event_id, bucket_key, capacity, epoch_us(ts) * capacity AS tick, row_number() OVER (PARTITION BY bucket_key ORDER BY ts, event_id) AS n FROM k),
f AS (SELECT *, true AS allowed, tick + {_LIMIT_WINDOW_S}000000 AS full_at FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.bucket_key, e.capacity, e.tick, e.n, greatest(f.full_at, e.tick) - e.tick <= (e.capacity - 1) * {_LIMIT_WINDOW_S}000000,
  CASE WHEN greatest(f.full_at, e.tick) - e.tick <= (e.capacity - 1) * {_LIMIT_WINDOW_S}000000 THEN greatest(f.full_at, e.tick) + {_LIMIT_WINDOW_S}000000 ELSE f.full_at END
  FROM f JOIN e ON e.bucket_key = f.bucket_key AND e.n = f.n + 1)
SELECT event_id, bucket_key, allowed, round(capacity::DOUBLE - (full_at - tick) / {_LIMIT_WINDOW_S}000000.0::DOUBLE, 6) AS tokens FROM f"""


def _called(events):
    """Requests with their caller's bucket; a long window lets the sparse test events run buckets dry."""
    token = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))
    return callers(events, token, F.concat("event_type", (F.col("user_id") % 40).cast("string")))


@query("rate_limited_callers", f"WITH {_SQL_LIMITED}")
def rate_limited_callers(spark, sf):
    called = _called(table(spark, sf, "events")).select("event_id", "ts", "bucket_key", "capacity")
    limited = token_bucket(called, "bucket_key", capacity="capacity", window_s=_LIMIT_WINDOW_S)
    return limited.select("event_id", "bucket_key", "allowed", r6("tokens").alias("tokens"))


# Streams -----------------------------------------------------------------------------------------
# Each stream reads the event table as a file source, then a file of later markers that moves the watermark
# past all events, runs until the input is used up and is then read back.

_DELAY = "2 hours"
_MARKER = -1  # event_id of the markers


def _stream(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = shared_folder(spark, f"events-{uuid.uuid4().hex}")
    events.write.parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    # one marker per kind of event, so that some pass any filter
    last = F.lit(events.agg(F.max("ts")).first()[0]) + F.expr("INTERVAL 60 DAYS")
    same = {c: F.first(c).alias(c) for c in events.columns if c not in ("event_type", "event_id", "ts", "user_id")}
    markers = events.groupBy("event_type").agg(*same.values()).withColumns(
        {"event_id": F.lit(_MARKER), "user_id": F.lit(_MARKER), "ts": last}
    )
    markers = markers.select([F.col(f.name).cast(f.dataType) for f in events.schema.fields])
    markers.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream):
    """Run a stream over all available input into a table in the shared folder and read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = shared_folder(spark, f"stream-{uuid.uuid4().hex}")
    run = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_SQL_START = "date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6) AS start, event_type AS path"


@query(
    "stream_latency",
    f"""WITH c AS (SELECT {_SQL_WINDOWS} FROM events GROUP BY 1, 2), p AS ({_sql_bucket_points("start, path", f"SELECT {_SQL_START}, value::DOUBLE AS v FROM events")})
SELECT CAST(start AS VARCHAR) AS start, path, requests, errors, p50, p95, p99 FROM c JOIN p USING (start, path)""",
)
def stream_latency(spark, sf):
    log = _log(_stream(spark, sf))
    closed = _drain(latency_stream(log, "6 hours", _DELAY))
    last = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("ts")).first().ts
    closed = closed.filter(F.col("start") <= F.lit(last))  # the markers' windows are later
    return closed.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "path", "requests", "errors",
        *[r6(p).alias(p) for p in ("p50", "p95", "p99")],
    )


@query("stream_token_bucket", f"WITH {_SQL_BUCKET} SELECT event_id, allowed, {_SQL_TOKENS} AS tokens FROM f")
def stream_token_bucket(spark, sf):
    events = _stream(spark, sf).select("event_id", "user_id", "ts")
    out = _drain(token_bucket_stream(events, "user_id", _DELAY, _BUCKET, _WINDOW_S))
    return out.filter(F.col("event_id") != _MARKER).select("event_id", "allowed", r6("tokens").alias("tokens"))


@query(
    "stream_feedback",
    f"""WITH {_SQL_SIGNALS} SELECT event_id, signal, CASE WHEN place % 2 = 1 THEN 'created' ELSE 'removed' END AS action, run_id FROM p""",
)
def stream_feedback(spark, sf):
    out = _drain(feedback_stream(signals(_stream(spark, sf)), _DELAY))
    return out.filter(F.col("event_id") != _MARKER).select("event_id", "signal", "action", "run_id")


@query("stream_rate_limited_callers", f"WITH {_SQL_LIMITED}")
def stream_rate_limited_callers(spark, sf):
    called = _called(_stream(spark, sf)).select("event_id", "ts", "bucket_key", "capacity")
    out = _drain(token_bucket_stream(called, "bucket_key", _DELAY, "capacity", _LIMIT_WINDOW_S))
    return out.filter(F.col("event_id") != _MARKER).select("event_id", "bucket_key", "allowed", r6("tokens").alias("tokens"))
