import hashlib
import math
import sys

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare
from helpers import rows
from matchloom.catalog import matching as catalog
from matchloom.functions.skills import Skill
from matchloom.operators.filters import apply_filters, effective_k, request_problems, validate_requests
from matchloom.operators.idf import build_idf
from matchloom.operators.key_filter import possible_rows
from matchloom.operators.matching import assemble, explain, hydrate, lexical_scorer, model_scorer, rerank, wanted_texts
from matchloom.operators.ranking import rank_delta, sort_results
from matchloom.operators.runs import skill_gap
from matchloom.plans.matching import match, match_distinct, nested_results, retrieve, retrieve_results

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stubs run in Python workers

TITLES = ("Registered Nurse", "Software Engineer", "Head Chef", "Sales Manager")
FAMILY = ("HEALTHCARE", "ENGINEERING", "CHEF", "SALES")


def stub_vector(text, dim=16):
    seed = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    v = np.random.default_rng(seed).normal(size=dim)
    return v / np.linalg.norm(v)


def stub_encoder():
    from matchloom.operators.encoding import model_encoder

    def load():
        return lambda texts: np.array([stub_vector(t) for t in texts])

    return model_encoder(load)


def stub_score(query, text):
    return (int(hashlib.sha256((query + text).encode()).hexdigest()[:8], 16) % 1000) / 1000


def stub_scorer():
    def load():
        return lambda pairs: np.array([stub_score(q, t) for q, t in pairs])

    return model_scorer(load)


@pytest.fixture(scope="module")
def corpus(spark):
    jobs = [
        (i, TITLES[i % 4], f"description {i} " + "x" * 1500, "skills", f"{TITLES[i % 4].lower()} number {i}", "CAT", FAMILY[i % 4])
        for i in range(20)
    ]
    postings = spark.createDataFrame(
        jobs, "job_id long, job_title string, description string, skills string, text string, job_category string, job_family string"
    ).cache()
    vectors = spark.createDataFrame(
        [(i, stub_vector(f"job {i}").tolist()) for i in range(20)], "item_id long, vec array<float>"
    ).cache()
    return postings, vectors, build_idf(postings).cache()


def requests(spark, data):
    return spark.createDataFrame(
        data, "query_id long, query_text string, top_k int, top_n int, job_families array<string>, min_score double, explain boolean"
    )


def run(spark, corpus, data):
    postings, vectors, idf = corpus
    return match(requests(spark, data), postings, vectors, idf, stub_encoder(), stub_scorer())


RESUME = "nurse with   patient care experience number 4"


def expected(depth, families, min_score, top_n):
    flat = " ".join(RESUME.split())
    q = np.float32(stub_vector(flat))
    sims = sorted(((-round(float(np.dot(np.float64(q), np.float64(np.float32(stub_vector(f"job {i}"))))), 6), i) for i in range(20)))[:depth]
    hits = [(i, rank) for rank, (_, i) in enumerate(sims, 1)]
    kept = [(i, r) for i, r in hits if not families or FAMILY[i % 4] in families]
    scored = sorted(((-stub_score(RESUME, f"{TITLES[i % 4].lower()} number {i}"), r, i) for i, r in kept))
    scored = [(s, r, i) for s, r, i in scored if min_score is None or 1 / (1 + math.exp(s)) >= min_score]
    return len(hits), len(scored), [(i, r, n, -s) for n, (s, r, i) in enumerate(scored[:top_n], 1)]


@pytest.mark.parametrize(
    "top_k, top_n, families, min_score",
    [(10, 5, None, None), (4, 5, ["CHEF", "SALES"], None), (6, 3, [], 0.6), (5, 10, ["HEALTHCARE"], 0.6), (4, 2, ["PILOT"], None)],
)
def test_match_semantics(spark, corpus, top_k, top_n, families, min_score):
    out = run(spark, corpus, [(1, RESUME, top_k, top_n, families, min_score, True)])
    depth = top_k * 3 if families else top_k
    total, filtered, want = expected(depth, families, min_score, top_n)
    got = sorted((r.job_id, r.retrieval_rank, r.rank, r.cross_encoder_score) for r in out.results.collect())
    assert got == sorted(want)
    counts = out.counts.first()
    assert (counts.total_candidates, counts.filtered_candidates) == (total, filtered)
    assert counts.resume_hash == hashlib.sha256(" ".join(RESUME.split()).encode()).hexdigest()[:16]


def test_degenerate_requests(spark, corpus):
    out = run(spark, corpus, [(1, "  ", 5, 5, None, None, True), (2, RESUME, 0, 5, None, None, True), (3, RESUME, 5, 2, None, None, False)])
    assert {(r.query_id, r.explanation) for r in out.results.collect()} == {(3, None)}
    assert {r.query_id: r.total_candidates for r in out.counts.collect()} == {1: 0, 2: 0, 3: 5}


def test_nested_rows_and_retrieve(spark, corpus):
    postings, vectors, _ = corpus
    out = run(spark, corpus, [(1, RESUME, 5, 3, None, None, True)])
    m = nested_results(out.results, postings).orderBy("match.rank").first().match
    assert len(m.description) == 1200 and m.rank == 1 and m.scores.skill_overlap == m.explanation.overlap_score
    assert abs(m.scores.cross_encoder_probability - 1 / (1 + math.exp(-m.cross_encoder_score))) < 1e-12
    first = retrieve_results(requests(spark, [(1, RESUME, 5, 3, ["CHEF"], 0.9, True)]), postings, vectors, stub_encoder())
    got = sorted((r["rank"], r.retrieval_rank, r.cross_encoder_score) for r in first.collect())
    assert got == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    plain = assemble(first.withColumn("job_family", F.lit(None).cast("string"))).first().match
    assert plain.job_family == "OTHER" and plain.explanation is None and plain.scores.skill_overlap == 0.0


def test_missing_posting_keeps_ranks(spark, corpus):
    postings, vectors, _ = corpus
    hits = retrieve(requests(spark, [(1, RESUME, 20, 5, None, None, True)]), postings, vectors, stub_encoder())
    best = hits.filter("retrieval_rank = 1").first().job_id
    fewer = retrieve(requests(spark, [(1, RESUME, 20, 5, None, None, True)]), postings.filter(F.col("job_id") != best), vectors, stub_encoder())
    assert sorted(r.retrieval_rank for r in fewer.collect()) == list(range(2, 21))
    pair = spark.createDataFrame([(1, 5), (1, 999)], "query_id long, job_id long")
    assert [r.job_id for r in hydrate(pair, postings).collect()] == [5]


def test_possible_rows(spark):
    """Every asked row passes, few others do; repeated and null keys and other column types change nothing."""
    rows_ = spark.range(20_000).select(F.col("id").alias("job_id"), F.lit(7).alias("_other"))
    rows_ = rows_.union(spark.createDataFrame([(None, 7)], "job_id long, _other int"))
    keys = spark.range(0, 20_000, 40).select(F.col("id").cast("int").alias("job_id"))
    keys = keys.union(keys).union(spark.createDataFrame([(None,)], "job_id int"))
    got = possible_rows(rows_, keys, "job_id")
    assert got.columns == rows_.columns
    ids = [r.job_id for r in got.collect()]
    assert set(range(0, 20_000, 40)) <= set(ids) and len(ids) == len(set(ids)) < 1_000 and None not in ids
    assert possible_rows(rows_, keys.limit(0), "job_id").count() == 0
    assert possible_rows(rows_.limit(0), keys, "job_id").count() == 0


def test_other_postings_are_not_exchanged(spark, tmp_path):
    """Above the scan of the postings the bitmap is tested before the first exchange by id."""
    spark.range(500).select(F.col("id").alias("job_id"), F.concat(F.lit("text "), "id").alias("text")).write.parquet(str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    pairs = spark.createDataFrame([(1, 5), (1, 7), (2, 5)], "query_id long, job_id long")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for df in (hydrate(pairs, postings), wanted_texts(pairs, postings, "score")):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha() or c == "*")
            at = next(i for i, line in enumerate(lines) if "FileScan" in line)
            above, level = [], depth(lines[at])
            for line in reversed(lines[:at]):
                if line.strip() and depth(line) < level:
                    above.append(line)
                    level = depth(line)
            joins = [i for i, line in enumerate(above) if "BroadcastHashJoin" in line and "_word" in line]
            exchanges = [i for i, line in enumerate(above) if "Exchange hashpartitioning(job_id" in line]
            assert joins and exchanges and joins[0] < exchanges[0]
            assert {r.job_id for r in df.collect()} == {5, 7}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_match_distinct(spark, corpus):
    seen = []

    def once(distinct):
        seen.append(distinct.count())
        return match(distinct, *corpus, stub_encoder(), stub_scorer())

    data = [(1, RESUME, 5, 2, None, None, True), (2, "  " + RESUME + "\n", 5, 2, None, None, True), (3, RESUME, 5, 3, None, None, True)]
    out = match_distinct(requests(spark, data), once)
    assert seen == [2]
    by_query = {q: [(r.job_id, r["rank"]) for r in out.filter(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert by_query[1] == by_query[2] == by_query[3][:2] and len(by_query[3]) == 3


def test_rerank_ties_keep_retrieval_order(spark):
    pairs = spark.createDataFrame([(1, 10, 3), (1, 11, 1), (1, 12, 2)], "query_id long, job_id long, retrieval_rank int")

    def flat(p, queries, postings):
        return p.withColumn("cross_encoder_score", F.when(F.col("job_id") == 10, 2.0).otherwise(1.0))

    got = rerank(pairs, None, None, flat, top_n=2).orderBy("rank").collect()
    assert [(r.job_id, r["rank"], r.retrieval_rank) for r in got] == [(10, 1, 3), (11, 2, 1)]
    assert [r.rank_delta for r in rank_delta(rerank(pairs, None, None, flat)).orderBy("rank").collect()] == [2, -1, -1]


def test_scorer_caps_the_posting_only(spark):
    queries = spark.createDataFrame([(1, "q" * 3000)], "query_id long, query_text string")
    postings = spark.createDataFrame([(1, "a  b " * 1000, None)], "job_id long, text string, description string")
    pairs = spark.createDataFrame([(1, 1)], "query_id long, job_id long")
    lengths = model_scorer(lambda: lambda p: np.array([len(q) * 10000 + len(t) for q, t in p]))
    assert lengths(pairs, queries, postings).first().cross_encoder_score == 3000 * 10000 + 1200


def test_lexical_scorer(spark):
    idf = spark.createDataFrame([("nurse", 2.0), ("icu", 3.5), ("chef", 9.0)], "term string, idf double")
    queries = spark.createDataFrame([(1, "nurse nurse icu")], "query_id long, query_text string")
    postings = spark.createDataFrame([(1, "ICU nurse wanted"), (2, "chef")], "job_id long, text string")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, job_id long")
    got = lexical_scorer(idf)(pairs, queries, postings)
    assert {r.job_id: r.cross_encoder_score for r in got.collect()} == {1: 5.5, 2: 0.0}


def test_explain(spark):
    lexicon = tuple(Skill(s, "x", (s,)) for s in ("icu", "triage", "python", "sql", "zz"))
    idf = spark.createDataFrame([("icu", 2.0), ("sql", 1.5), ("ward", 1.2), ("low", 0.5), ("triage", 1.9)], "term string, idf double")
    queries = spark.createDataFrame([(1, "ICU ward triage low unknown")], "query_id long, query_text string")
    postings = spark.createDataFrame(
        [(1, "the ICU ward, low unknown; python sql zz"), (2, ""), (3, "y" * 1200 + " icu")], "job_id long, text string"
    )
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, job_id long")
    got = {r.job_id: r.explanation for r in explain(pairs, queries, postings, idf, lexicon).collect()}
    e = got[1]
    assert e.matched_skills == ["icu"] and e.missing_skills == ["sql", "python", "zz"] and e.overlap_score == 0.25
    assert [(t.term, t.weight) for t in e.matched_terms] == [("icu", 2.0), ("ward", 1.2)]
    for job in (2, 3):  # nothing in common; text beyond the cap does not count
        assert (got[job].matched_skills, got[job].missing_skills, got[job].matched_terms, got[job].overlap_score) == ([], [], [], 0.0)
    many = spark.createDataFrame([(f"t{i:02}", 2.0) for i in range(30)], "term string, idf double")
    words = " ".join(f"t{i:02}" for i in range(30))
    q, p = queries.withColumn("query_text", F.lit(words)), postings.filter("job_id = 1").withColumn("text", F.lit(words))
    top = explain(pairs.filter("job_id = 1"), q, p, many, lexicon).first().explanation.matched_terms
    assert [t.term for t in top] == [f"t{i:02}" for i in range(12)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "A", 5.0), (2, "A", -5.0), (3, "B", None)], "job_id long, job_family string, cross_encoder_score double")
    ids = lambda d: sorted(r.job_id for r in d.collect())
    assert ids(apply_filters(df, min_score=0.5)) == [1, 3]
    assert ids(apply_filters(df, ["A"])) == [1, 2]
    assert ids(apply_filters(df, [])) == [1, 2, 3]
    assert ids(apply_filters(df.drop("cross_encoder_score"), ["B"], 0.9)) == [3]
    assert ids(apply_filters(df.withColumn("w", F.array(F.lit("B"))), F.col("w"))) == [3]
    k = spark.createDataFrame([(10, ["A"]), (10, []), (10, None)], "top_k int, f array<string>")
    assert [r.k for r in k.select(effective_k("top_k", "f").alias("k")).collect()] == [30, 10, 10]


def test_validation(spark):
    data = [("x" * 40, 30, 10, None), ("x" * 39, 0, 51, 1.5), ("x" * 20001, 201, 0, -0.1), ("x" * 20000, 200, 50, 1.0)]
    df = spark.createDataFrame(data, "resume_text string, top_k int, top_n int, min_score double")
    assert [len(r.reasons) for r in request_problems(df).collect()] == [0, 4, 4, 0]
    valid, rejected = validate_requests(df)
    assert valid.count() == 2 and rejected.count() == 2 and "reasons" not in valid.columns


def test_sort_and_gap(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.5, 0.1, 0.0), (1, 2, 0.9, 0.1, 1.0), (1, 3, 0.5, 0.2, 0.0)],
        "query_id int, rank int, cross_encoder_probability double, bi_encoder double, skill_overlap double",
    )
    order = lambda mode: [r["rank"] for r in sort_results(df, mode).orderBy("position").collect()]
    assert (order("relevance"), order("semantic"), order("skill_coverage")) == ([2, 1, 3], [3, 1, 2], [2, 1, 3])
    missing = spark.createDataFrame(
        [(1, 1, ["A", "B"]), (1, 2, ["A"]), (1, 3, ["A", "C"]), (1, 4, None), (1, 11, ["Z"])], "query_id int, rank int, missing_skills array<string>"
    )
    assert rows(skill_gap(missing)) == [(1, "A", 3), (1, "B", 1), (1, "C", 1)]
    assert rows(skill_gap(missing, shown=1)) == [(1, "A", 3)]


def test_documents_without_a_vector_go_before_their_texts_are_shuffled(spark, tmp_path):
    docs = [(1, "a", "en", "web"), (2, "b", "de", "web"), (2, "c", "de", "web"), (None, "d", "en", "web"), (9, None, "fr", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(2, [1.0], 3), (2, [2.0], 4), (9, [3.0], None), (7, [4.0], 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    joined = catalog._vector_texts(spark, str(tmp_path), "label")
    got = sorted((r.doc_id, r.text or "", r.label or 0) for r in joined.collect())
    assert got == [(2, "b", 3), (2, "b", 4), (2, "c", 3), (2, "c", 4), (9, "", 0)]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")  # the bitmap stands below the join
    for of in (catalog._postings(spark, str(tmp_path)), catalog._requests(spark, str(tmp_path))):
        assert "Join LeftSemi" in of._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents whose common words stand beyond their first 1,200 characters, and vectors of which more than 20 of the
    best 30 have the label that the second of two runs leaves out."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(11)
    words = ("the", "and", "les", "dans", "der", "los", "vault", "kiln", "moor", "reed", "tarn", "weir")
    pick = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, f"{pick(4)} {f'filler{i} ' * 150 if i % 3 else ''}{pick(5)} tail{i % 5}", "en", "web") for i in range(60)]
    docs += [(60, None, "en", "web"), (61, "the kiln", "en", "web"), (99, "the reed", "en", "web")]
    centre = stub_vector("centre", 8)
    near = [(i, centre + 0.05 * stub_vector(f"v {i}", 8), 1 if i else 0) for i in range(35)]
    far = [(i, stub_vector(f"v {i}", 8), i % 10) for i in range(35, 61)] + [(61, stub_vector("v 61", 8), 5)]
    vectors = [(i, (v / np.linalg.norm(v)).tolist(), label) for i, v, label in near + far]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["compare_runs", "compare_skills"])
def test_runs_are_whole_where_one_label_crowds_the_best(spark, tables, name):
    folder, con = tables
    assert compare(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name]) is None


def test_explain_matches_reads_whole_texts(spark, tables):
    """The last term of a long text is weighed, scored and explained."""
    folder, con = tables
    df = entry.queries()["explain_matches"](spark, folder)
    assert compare(df, con, entry.oracle_sql()["explain_matches"]) is None
    own = {r.query_id: r.matched_terms.split("|") for r in df.filter("query_id = job_id").collect()}
    long = [i for i in own if i < 60 and i % 3]
    assert long and all(f"tail{i % 5}" in own[i] for i in long)


def test_whole_texts_are_scored_and_explained(spark):
    lexicon = (Skill("icu", "x", ("icu",)),)
    text = "y" * 1300 + " icu"
    queries = spark.createDataFrame([(1, text)], "query_id long, query_text string")
    postings = spark.createDataFrame([(1, text)], "job_id long, text string")
    pairs = spark.createDataFrame([(1, 1)], "query_id long, job_id long")
    idf = build_idf(postings, chars=None)
    assert [r.term for r in idf.filter("term = 'icu'").collect()] == ["icu"] and build_idf(postings).filter("term = 'icu'").isEmpty()
    weight = idf.filter("term = 'icu'").select(F.lit(1).cast("long").alias("query_id"), "term", "idf")
    assert lexical_scorer(weight)(pairs, queries, postings).first().cross_encoder_score == 0.0
    assert lexical_scorer(weight, chars=None)(pairs, queries, postings).first().cross_encoder_score == 1.0
    whole, capped = (explain(pairs, queries, postings, weight, lexicon, chars=n).first().explanation for n in (None, 1200))
    assert (whole.matched_skills, [t.term for t in whole.matched_terms], whole.overlap_score) == (["icu"], ["icu"], 1.0)
    assert (capped.matched_skills, capped.matched_terms) == ([], [])
