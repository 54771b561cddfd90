import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from matchloom.operators.idf import build_idf
from matchloom.operators.latency import latency_windows
from matchloom.operators.metrics import (
    attach_truth, candidate_counts, corpus_summary, exact_percentiles, family_facet, quantile_buckets, latency_percentiles, mean_ndcg, ndcg,
)
from matchloom.operators.rate_limit import token_bucket
from matchloom.plans.evaluation import compare_systems
from matchloom.streaming.feedback import feedback_stream
from matchloom.streaming.latency import latency_stream
from matchloom.streaming.ordered_fold import late_rows, state_rows
from matchloom.streaming.rate_limit import token_bucket_stream
from test_history import SCHEMA, events, simulate

T0 = datetime(2024, 1, 1)


def hand_ndcg(labels, scores, k):
    """Tie-averaged NDCG written out: each group of equal scores shares its mean gain."""
    if len(labels) < 2:
        return None
    discount = [1 / math.log2(i + 2) if i < k else 0.0 for i in range(len(labels))]
    order = sorted(range(len(labels)), key=lambda i: -scores[i])
    mean = {s: np.mean([labels[i] for i in order if scores[i] == s]) for s in set(scores)}
    dcg = sum(mean[scores[i]] * d for i, d in zip(order, discount))
    ideal = sum(label * d for label, d in zip(sorted(labels, reverse=True), discount))
    return dcg / ideal if ideal else 0.0


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ndcg(spark, k):
    rng = random.Random(k)
    lists = [([rng.randrange(3) for _ in range(n)], [rng.randrange(4) / 2 for _ in range(n)]) for n in (1, 2, 5, 12, 30)]
    lists.append(([0, 0, 0], [1.0, 2.0, 3.0]))
    data = [(q, s, label) for q, (labels, scores) in enumerate(lists) for label, s in zip(labels, scores)]
    got = {r.query_id: r.ndcg for r in ndcg(spark.createDataFrame(data, "query_id int, score double, relevance int"), k).collect()}
    for q, (labels, scores) in enumerate(lists):
        want = hand_ndcg(labels, scores, k)
        assert got[q] is None if want is None else abs(got[q] - want) < 1e-12


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (2, 10, 0)], "query_id long, job_id long, relevance int")
    results = spark.createDataFrame(
        [(1, 10, 0.1, 5.0), (1, 99, 0.9, 1.0), (2, 10, 0.5, 0.5), (2, 11, 0.4, 0.4)],
        "query_id long, job_id long, bi_encoder_score double, cross_encoder_score double",
    )
    assert sorted((r.query_id, r.job_id, r.relevance) for r in attach_truth(results, truth).collect()) == [(1, 10, 1), (1, 99, 0), (2, 10, 0), (2, 11, 0)]
    got = {r.system: (r.queries, r.mean_ndcg) for r in compare_systems(results, results, truth).collect()}
    assert got["reranked"] == (1, 1.0) and abs(got["retrieval"][1] - 1 / math.log2(3)) < 1e-12
    per_query = ndcg(attach_truth(results, truth), score="cross_encoder_score")
    assert mean_ndcg(per_query, truth).first().queries == 1  # query 2 has nothing relevant
    all_truth = ndcg(attach_truth(results.filter("job_id = 99 or query_id = 2"), truth), score="bi_encoder_score", ideal=truth)
    assert {r.query_id: r.ndcg for r in all_truth.collect()} == {1: None, 2: 0.0}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=997), "b": np.repeat(3.5, 50), "c": np.array([7.0]), None: rng.integers(0, 5, 300).astype(float),
              "d": np.concatenate([rng.exponential(size=400), [1e9, -1e9]])}
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("e", None)]
    df = spark.createDataFrame(data, "g string, took_ms double").repartition(5)
    got = {r.g: (r.p50, r.p95, r.p99) for r in latency_percentiles(df, by=["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.percentile(values, [50, 95, 99]), rtol=1e-12)
    whole = exact_percentiles(df, "took_ms", [], {"p0": 0.0, "p100": 1.0}).first()
    assert (whole.p0, whole.p100) == (-1e9, 1e9)
    assert latency_percentiles(df.filter("false"), by=["g"]).count() == 0
    sketch = {r.g: r.p50 for r in latency_percentiles(df, by=["g"], exact=False).collect()}
    assert abs(sketch["a"] - got["a"][0]) < 0.05


def test_quantile_buckets_cut_long_tails(spark):
    """Log-normal values, one group a third of the rows: no bucket holds over 2 % of a group; NaN counts as the largest."""
    rng = np.random.default_rng(2)
    values = {"a": np.exp(3 * rng.normal(size=6000)), "b": np.exp(8 * rng.normal(size=3000))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, _v double").repartition(6)
    for g, n in quantile_buckets(df, ["g"], 256).groupBy("g", "_bucket").count().groupBy("g").agg(F.max("count")).collect():
        assert n <= 0.02 * len(values[g])
    points = {"p0": 0.0, "p37": 0.37, "p999": 0.999, "p100": 1.0}
    for got in exact_percentiles(df, "_v", ["g"], points, buckets=8, rounds=3).collect():
        assert np.allclose(got[1:], np.percentile(values[got.g], [0, 37, 99.9, 100]), rtol=1e-12)
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    top = exact_percentiles(odd, "v", [], {"mid": 0.5, "top": 1.0}).first()
    assert top.mid == 2.0 and np.isnan(top.top)


def test_reports(spark):
    jobs = spark.createDataFrame([("SALES", "X"), ("OTHER", "Y"), ("OTHER", "Z"), ("HR", "X")], "job_family string, job_category string")
    assert [tuple(r) for r in family_facet(jobs).collect()] == [("HR", "Hr", 1), ("SALES", "Sales", 1), ("OTHER", "Other", 2)]
    resumes = spark.createDataFrame([("A",), ("B",)], "resume_category string")
    pairs = spark.createDataFrame([(1,), (0,), (0,), (0,)], "relevance int")
    s = corpus_summary(jobs, resumes, pairs).first()
    assert (s.jobs, s.resumes, s.pairs, s.positive_rate, s.family_coverage, s.job_categories, s.resume_categories) == (4, 2, 4, 0.25, 0.5, 3, 2)
    c = spark.createDataFrame([(1, True), (1, False)], "query_id int, survived boolean")
    assert rows(candidate_counts(c)) == [(1, 2, 1)]


def test_idf(spark):
    df = spark.createDataFrame([("Spark spark the SQL",), ("spark " + "x" * 1200 + " late",), ("",), (None,)], "text string")
    got = {r.term: (r.df, r.idf) for r in build_idf(df).collect()}
    assert got["spark"][0] == 2 and abs(got["spark"][1] - (math.log(5 / 3) + 1)) < 1e-12
    assert "the" not in got and "late" not in got and abs(got["sql"][1] - (math.log(5 / 2) + 1)) < 1e-12
    assert [r.term for r in build_idf(df, max_terms=1).collect()] == ["spark"]


def bucket_simulation(calls, capacity, window_s):
    """The limiter event by event, with tokens and the time of the last allowed event as state."""
    state, out = {}, {}
    for event_id, ts, user in sorted(calls, key=lambda c: (c[1], c[0])):
        now = (ts - T0).total_seconds()
        tokens, last = state.get(user, (float(capacity), now))
        tokens = min(float(capacity), tokens + (now - last) * capacity / window_s)
        out[event_id] = tokens >= 1.0
        if tokens >= 1.0:
            state[user] = (tokens - 1.0, now)
    return out


def bucket_events(seed, n, users, spread):
    rng = random.Random(seed)
    return [(i, T0 + timedelta(microseconds=rng.randrange(spread * 1_000_000)), rng.choice([0] * users + list(range(users)))) for i in range(n)]


@pytest.mark.parametrize("n, users, spread, capacity, window", [(600, 4, 2000, 30, 60), (400, 3, 20_000, 3, 60), (500, 1, 100, 5, 7)])
def test_token_bucket_equals_simulation(spark, n, users, spread, capacity, window):
    calls = bucket_events(n, n, users, spread)
    df = spark.createDataFrame(calls, "event_id long, ts timestamp, user_id long")
    got = token_bucket(df, "user_id", capacity=capacity, window_s=window)
    want = bucket_simulation(calls, capacity, window)
    assert dict(rows(got.select("event_id", "allowed"))) == want
    assert got.agg(F.min("tokens"), F.max("tokens")).first()[1] <= capacity - 1 + 1e-9 or not all(want.values())
    assert rows(got) == rows(token_bucket(df.repartition(7), "user_id", capacity=capacity, window_s=window))


def test_token_bucket_boundary(spark):
    """A full burst, then one token exactly when it has refilled."""
    times = [0.0] * 31 + [1.999999, 2.0, 2.0]
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1) for i, s in enumerate(times)], "event_id long, ts timestamp, user_id long")
    got = [r.allowed for r in token_bucket(df, "user_id").orderBy("event_id").collect()]
    assert got == [True] * 30 + [False, False, True, False]


def write_batches(spark, df, path, n=3):
    """Files in time order, read one per micro-batch."""
    ordered = df.orderBy("ts", "event_id").collect()
    total = len(ordered)
    for b in range(n):
        part = ordered[b * total // n : (b + 1) * total // n]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def drain(spark, stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_feedback_stream_equals_batch(spark, tmp_path):
    calls = events(200, 2, 20_000, 9)
    last = T0 + timedelta(days=3)  # moves the watermark past everything before it
    df = spark.createDataFrame(calls + [(9999, last, 77, 1, 1, "up")], SCHEMA)
    write_batches(spark, df, str(tmp_path / "in"))
    out = drain(spark, feedback_stream(source(spark, df, str(tmp_path / "in")), "1 hour"), tmp_path)
    assert dict(rows(out.select("event_id", "action"))) == simulate(calls)[0]
    assert out.filter("run_id IS NULL").count() == sum(c[3] is None for c in calls)


def test_feedback_stream_with_text_runs(spark, tmp_path):
    calls = events(120, 2, 20_000, 9)
    df = spark.createDataFrame([*calls, (9999, T0 + timedelta(days=3), 77, 1, 1, "up")], SCHEMA)
    df = df.withColumn("run_id", F.concat(F.lit("run-"), F.col("run_id").cast("string")))
    write_batches(spark, df, str(tmp_path / "in"))
    out = drain(spark, feedback_stream(source(spark, df, str(tmp_path / "in")), "1 hour"), tmp_path)
    assert dict(rows(out.select("event_id", "action"))) == simulate(calls)[0]


def test_rate_stream_equals_batch(spark, tmp_path):
    calls = bucket_events(5, 250, 3, 1500)
    df = spark.createDataFrame(calls + [(9999, T0 + timedelta(days=3), 77)], "event_id long, ts timestamp, user_id long")
    write_batches(spark, df, str(tmp_path / "in"))
    stream = token_bucket_stream(source(spark, df, str(tmp_path / "in")), "user_id", "10 minutes", 5, 60)
    out = drain(spark, stream, tmp_path)
    assert dict(rows(out.select("event_id", "allowed"))) == bucket_simulation(calls, 5, 60)


def test_latency_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    log = [(i, T0 + timedelta(minutes=i), f"/p{i % 2}", 500 if i % 10 == 0 else 200, rng.random() * 100) for i in range(300)]
    log.append((9999, T0 + timedelta(days=3), "/end", 200, 1.0))
    df = spark.createDataFrame(log, "event_id long, ts timestamp, path string, status int, took_ms double")
    write_batches(spark, df, str(tmp_path / "in"))
    out = drain(spark, latency_stream(source(spark, df, str(tmp_path / "in")), "1 hour", "10 minutes"), tmp_path)
    cols = ["start", "path", "requests", "errors", "error_rate"]
    batch = latency_windows(df.filter("path <> '/end'"), "1 hour")
    assert rows(out.select(*cols)) == rows(batch.select(*cols))
    both = out.alias("s").join(batch.alias("b"), ["start", "path"])
    assert both.filter(F.abs(F.col("s.p50") - F.col("b.p50")) > 15).count() == 0
    sketch = latency_windows(df.filter("path <> '/end'"), "1 hour", exact=False)
    points = [*cols, "p50", "p95", "p99"]
    assert rows(out.select(*points)) == rows(sketch.select(*points))


def test_log_buckets_keep_the_relative_error(spark):
    rng = random.Random(7)
    values = [rng.lognormvariate(0, 4) for _ in range(5000)] + [0.0, -1.0, 1e-9, 1e12, None]
    df = spark.createDataFrame([(v,) for v in values], "took_ms double")
    known = sorted(max(0.0, v) for v in values if v is not None)
    got = latency_percentiles(df, exact=False).first()
    for name, point in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        want = known[int(point * (len(known) - 1))]
        assert abs(got[name] - want) <= 0.0101 * want


def test_late_rows_are_counted_and_idle_state_goes(spark, tmp_path):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    batches = [
        [(1, at(0), 1, 2), (2, at(0), 1, 2), (2, at(0), 1, 2), (3, at(1), 2, 1), (4, at(1), 2, 1)],
        [(5, at(200), 3, 5)],  # moves the watermark past keys 1 and 2
        [(8, at(201), 3, 5)],  # Spark leaves out what was late a batch ago
        [(6, at(1), 1, 2), (7, at(3), 2, 1)],  # late
        [(9, at(900), 9, 5)],
        [(10, at(901), 9, 5)],
        [(11, at(902), 9, 5)],
    ]
    schema = "event_id long, ts timestamp, who long, tokens_of long"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in order of their times
    frame = spark.createDataFrame([], schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = token_bucket_stream(source(spark, frame, str(tmp_path / "in")), "who", "10 minutes", "tokens_of", 60)
    run = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    found = sorted((r.event_id, r.allowed) for r in out.collect())
    assert [f for f in found if f[0] < 9] == [(1, True), (2, False), (2, True), (3, True), (4, False), (5, True), (8, True)]
    assert late_rows(run) == 2
    # keys 1, 2 and 3 left nothing: what remains belongs to key 9
    keys = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "ckpt"))
    assert {r.key.who for r in keys.collect()} <= {9} and state_rows(run) > 0


def test_streams_touch_state_by_shard_and_not_by_row(spark, tmp_path):
    """Null and long keys are keys like any other; waiting rows lie in few entries of state, whatever their number."""
    calls = [(i, T0 + timedelta(seconds=i % 50), [None, 2**60 + 1, 2**60 + 2, 5][i % 4]) for i in range(400)]
    schema = "event_id long, ts timestamp, user_id long"
    df = spark.createDataFrame([*calls, (9999, T0 + timedelta(days=3), 77)], schema)
    write_batches(spark, df, str(tmp_path / "in"), 2)
    out = drain(spark, token_bucket_stream(source(spark, df, str(tmp_path / "in")), "user_id", "10 minutes", 5, 60, shards=2), tmp_path)
    assert dict(rows(out.select("event_id", "allowed"))) == bucket_simulation(calls, 5, 60)
    assert dict(rows(out.select("event_id", "user_id"))) == {c[0]: c[2] for c in calls}
    first = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 0).load(str(tmp_path / "ckpt"))
    assert 0 < first.count() <= 2
