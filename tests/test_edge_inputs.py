"""Inputs the driver tables do not hold: several files, null and text ids, repeated ids, deep requests."""

import sys
import unicodedata

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from helpers import rows
from matchloom.functions.text import highlight_parts, nfkc
from matchloom.operators.encoding import encode_incremental, model_encoder
from matchloom.operators.idf import build_idf
from matchloom.operators.knn import knn_ann, knn_exact, most_cells, read_cells, write_cells
from matchloom.operators.matching import lexical_scorer
from matchloom.operators.rate_limit import callers, token_bucket
from matchloom.operators.sampling import build_pairs, group_sides, holdout_groups
from matchloom.plans.corpus import clean_postings, prepare_corpus, rejected_ids
from matchloom.plans.matching import match, retrieve_results
from matchloom.sources.csv import POSTING_ALIASES, read_aliased_csv
from matchloom.sources.tables import append_vectors, read_vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def corpus(spark):
    jobs = [(i, f"title {i}", f"word{i % 7} common text", "", f"title {i} word{i % 7} common text", "C", "F") for i in range(90)]
    postings = spark.createDataFrame(
        jobs, "job_id long, job_title string, description string, skills string, text string, job_category string, job_family string"
    )
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(90)], "item_id long, vec array<float>")
    asked = [(q, "common text", 100, 100, rng.normal(size=8).tolist()) for q in range(2)]
    requests = spark.createDataFrame(asked, "query_id long, query_text string, top_k int, top_n int, vec array<float>")
    return requests, postings, vectors


def test_more_than_fifty_results(corpus):
    requests, postings, vectors = corpus
    results = match(requests.withColumn("explain", F.lit(False)), postings, vectors, build_idf(postings)).results
    assert {r.query_id: r["count"] for r in results.groupBy("query_id").count().collect()} == {0: 90, 1: 90}
    assert retrieve_results(requests, postings, vectors).count() == 180


def test_cells_beyond_the_bound_are_refused(corpus):
    requests, _, vectors = corpus
    with pytest.raises(ValueError, match="cells"):
        knn_exact(requests, vectors, 3, n_cells=10_000)
    assert most_cells(2000) == 4000 and most_cells(8) == 4096
    everywhere = knn_ann(requests, vectors, 5, nprobe=10_000)
    assert rows(everywhere) == rows(knn_exact(requests, vectors, 5))


def test_ragged_vectors_are_refused(spark, corpus):
    requests, _, _ = corpus
    ragged = spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 7)], "item_id long, vec array<float>")
    with pytest.raises(Exception, match="one width"):
        knn_exact(requests, ragged, 1).collect()


def test_only_candidates_are_tokenised(corpus):
    requests, postings, _ = corpus
    pairs = requests.select("query_id", F.lit(3).cast("long").alias("job_id"))
    scored = lexical_scorer(build_idf(postings))(pairs, requests.select("query_id", "query_text"), postings)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and scored.count() == 2


def test_null_groups_stay(spark):
    pairs = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (2, "d")], "resume_id long, x string")
    train, held = holdout_groups(pairs, 0.4)
    assert train.count() + held.count() == 4
    assert sorted(r.is_eval for r in group_sides(pairs, "resume_id", 0.4).collect()) == [False, True, True]
    nulls = [df.filter("resume_id IS NULL").count() for df in (train, held)]
    assert sorted(nulls) == [0, 2]


def test_labels_of_repeated_resume_ids(spark):
    resumes = spark.createDataFrame([(9, "A"), (9, "B"), (9, "A")], "resume_id long, resume_category string")
    postings = spark.createDataFrame([(i, "alpha" if i % 2 else "beta") for i in range(8)], "job_id long, job_title string")
    taxonomy = {"A": ("alpha",), "B": ("beta",)}
    word = {"A": "alpha", "B": "beta"}
    titles = {r.job_id: r.job_title for r in postings.collect()}
    for seed in range(6):
        got = build_pairs(resumes, postings, taxonomy, 3, 1, seed).collect()
        assert got and len({(r.resume_id, r.job_id) for r in got}) == len(got)
        assert all(r.relevance == int(titles[r.job_id] == word[r.resume_category]) for r in got)


def test_text_ids_are_reported(spark, tmp_path):
    (tmp_path / "jobs.csv").write_text("job_id,title,description\n1,Nurse,a\nA1,Cook,b\nA2,Cook,b\n2,Cook,c\n")
    (tmp_path / "resumes.csv").write_text("id,category,resume_str\n1,CHEF,cooking\nx9,CHEF,baking\n")
    raw = read_aliased_csv(spark, str(tmp_path / "jobs.csv"), POSTING_ALIASES)
    assert rows(rejected_ids(raw, "job_id")) == [("A1",), ("A2",)]
    assert sorted(r.job_id for r in clean_postings(raw).collect()) == [1, 2]
    tables = prepare_corpus(spark, str(tmp_path / "jobs.csv"), str(tmp_path / "resumes.csv"), str(tmp_path / "out"))
    assert rows(tables["rejected"]) == [("postings", "A1"), ("postings", "A2"), ("resumes", "x9")]


def test_headers_of_each_file(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    (folder / "a.csv").write_text("job_id,title\n1,One\n")
    (folder / "b.csv").write_text('"Title",other,JOB_ID\n"Two, too",x,2\n')
    (folder / "c.csv").write_text("position\nThree\n")
    got = read_aliased_csv(spark, str(folder), POSTING_ALIASES)
    assert rows(got.select("job_id", "title")) == sorted([("1", "One"), ("2", "Two, too"), (None, "Three")], key=repr)
    (folder / "d.csv").write_text("nothing,known\n1,2\n")
    with pytest.raises(ValueError, match="d.csv"):
        read_aliased_csv(spark, str(folder), POSTING_ALIASES)


def test_store_and_encoder_run_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            seen.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return model

    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "id long, body string")
    store = str(tmp_path / "store")
    vectors, fresh = encode_incremental(df, "body", None, model_encoder(load), "m")
    append_vectors(fresh, store)
    append_vectors(fresh, store)
    assert vectors.count() == 20 and fresh.count() == 5 and read_vectors(spark, store).count() == 5
    again, nothing = encode_incremental(df, "body", read_vectors(spark, store), model_encoder(load), "m")
    assert nothing.count() == 0 and again.count() == 20 and seen.value == 5


def test_limiter_treats_null_as_a_key(spark):
    events = spark.createDataFrame([(i, None, i) for i in range(6)], "event_id long, user_id long, s long")
    events = events.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = [r.allowed for r in token_bucket(events, "user_id", capacity=3, window_s=600).orderBy("event_id").collect()]
    assert got == [True] * 3 + [False] * 3


def test_limiter_with_two_kinds_of_callers(spark):
    log = spark.createDataFrame([(i, "t" if i % 2 else None, "addr", 0) for i in range(300)], "event_id long, token string, addr string, s long")
    log = callers(log.withColumn("ts", F.timestamp_seconds("s")), F.col("token"), F.col("addr"))
    got = token_bucket(log, "bucket_key", capacity="capacity")
    assert rows(got.filter("allowed").groupBy("capacity").count()) == [(120, 120), (30, 30)]


def test_highlight_with_any_character(spark):
    texts = [("a\u0001b Java c", ["java", "b"]), ("java", ["java"]), ("", ["x"]), ("none", []), (None, ["x"]), ("c++ C++", ["c++"]), ("end x", ["x"])]
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(texts)], "i int, t string, w array<string>")
    got = [[tuple(p) for p in r.h] for r in df.select("i", highlight_parts("t", "w").alias("h")).orderBy("i").collect()]
    assert got == [
        [("a\u0001", False), ("b", True), (" ", False), ("Java", True), (" c", False)],
        [("", False), ("java", True), ("", False)],
        [("", False)],
        [("none", False)],
        [("", False)],
        [("", False), ("c++", True), (" ", False), ("C++", True), ("", False)],
        [("end ", False), ("x", True), ("", False)],
    ]


def test_nfkc(spark):
    texts = ["ﬁne", "①②", "é", "plain", None, "", "Ⅷ ½ ㎏", "한글"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", nfkc("t").alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_stored_index(spark, corpus, tmp_path):
    requests, _, vectors = corpus
    path = str(tmp_path / "cells")
    write_cells(vectors, path, n_cells=9)
    index = read_cells(spark, path)
    assert rows(knn_exact(requests, index, 7)) == rows(knn_exact(requests, vectors, 7))
    assert rows(knn_ann(requests, index, 7, nprobe=9)) == rows(knn_exact(requests, vectors, 7))
    assert knn_ann(requests, index, 7, nprobe=1).count() > 0
    with pytest.raises(ValueError, match="cells already"):
        knn_exact(requests, index, 7, n_cells=3)
    with pytest.raises(ValueError, match="no vectors"):
        write_cells(vectors.filter("false"), str(tmp_path / "none"))
