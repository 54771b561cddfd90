import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import rows
from matchloom.functions.taxonomy import FAMILIES
from matchloom.operators.ranking import keep_first, keep_newest, page_of, quota_overflow, with_dense_id, with_hash_position, with_ingest_order
from matchloom.operators.sampling import (
    build_pairs, extra_categories, holdout, holdout_rows, sample_sizes, strata_sizes, stratified_sample,
)

TITLES = ["registered nurse", "software engineer", "sales manager", "sales engineer", "pastry chef", "clown"]


def postings(spark, n=60, parts=3):
    data = [(i, TITLES[i % len(TITLES)]) for i in range(n)]
    return spark.createDataFrame(data, "job_id long, job_title string").repartition(parts)


def resumes(spark, parts=3):
    cats = ["HEALTHCARE", "SALES", "ENGINEERING", "CHEF", "CLOWN", "ASTRONAUT"]
    return spark.createDataFrame([(i, cats[i % 6]) for i in range(30)], "resume_id long, resume_category string").repartition(parts)


def test_hash_position_is_dense_and_stable(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3))
    one_part = rows(with_hash_position(df.coalesce(1), ["id"], ["g"], bits=4))
    assert one_part == rows(with_hash_position(df.repartition(7), ["id"], ["g"], bits=4))
    by_group = defaultdict(list)
    for _, g, position in one_part:
        by_group[g].append(position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_group.values()) and len(by_group) == 3
    plain = {r.id: r.position for r in with_hash_position(spark.range(300), ["id"], bits=6).collect()}
    finer = {r.id: r.position for r in with_hash_position(spark.range(300), ["id"], bits=2).collect()}
    assert plain == finer and sorted(plain.values()) == list(range(1, 301))
    assert plain != {r.id: r.position for r in with_hash_position(spark.range(300), ["id"], seed=1).collect()}


def test_ingest_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    ordered = with_ingest_order(spark.read.parquet(path)).collect()
    assert sorted(r.ingest_ord for r in ordered) == list(range(1, 1001))
    text = tmp_path / "lines.txt"
    text.write_text("\n".join(f"row {i}" for i in range(200)))
    scan = spark.read.text(str(text))
    assert {r.value: r.id for r in with_dense_id(scan, "id").collect()} == {f"row {i}": i + 1 for i in range(200)}
    assert with_dense_id(spark.range(3), "id").columns == ["id"]
    for i, n in enumerate((5, 4000, 1, 900, 60)):  # splits are packed by size, ids follow the paths
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{i}.txt").write_text("".join(f"{i} {j:05}\n" for j in range(n)))
    scan = spark.read.text(str(tmp_path / "many")).filter("value <> '1 00007'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = with_ingest_order(scan).orderBy("ingest_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in got] == sorted(r.value for r in got) and [r.ingest_ord for r in got] == list(range(1, 4966))
    assert got[0].asDict().keys() == {"value", "ingest_ord"}


def test_build_pairs(spark):
    extra = extra_categories(resumes(spark), FAMILIES)
    assert rows(extra) == [("ASTRONAUT", "ASTRONAUT"), ("CLOWN", "CLOWN")]
    pairs = build_pairs(resumes(spark), postings(spark), FAMILIES, negative_ratio=3, positives=2, categories=extra)
    matches = {
        "HEALTHCARE": {"registered nurse"}, "SALES": {"sales manager", "sales engineer"},
        "ENGINEERING": {"software engineer", "sales engineer"}, "CHEF": {"pastry chef"}, "CLOWN": {"clown"},
    }
    by_resume = defaultdict(list)
    for r in pairs.collect():
        assert (TITLES[r.job_id % 6] in matches[r.resume_category]) == bool(r.relevance)
        by_resume[r.resume_id].append((r.relevance, r.job_id))
    assert len(by_resume) == 25  # astronauts match nothing and are skipped
    for drawn in by_resume.values():
        assert Counter(label for label, _ in drawn) == {1: 2, 0: 6}
        assert len({job for _, job in drawn}) == 8
    again = build_pairs(resumes(spark, 1), postings(spark, parts=8), FAMILIES, 3, 2, categories=extra)
    assert rows(pairs) == rows(again)
    assert rows(pairs) != rows(build_pairs(resumes(spark), postings(spark), FAMILIES, 3, 2, seed=1, categories=extra))
    spread = {job for drawn in by_resume.values() for _, job in drawn}
    assert len(spread) > 45  # draws reach most of the 60 postings


def test_build_pairs_without_negatives(spark):
    only = spark.createDataFrame([(1, "nurse"), (2, "clinical nurse")], "job_id long, job_title string")
    one = spark.createDataFrame([(9, "HEALTHCARE")], "resume_id long, resume_category string")
    pairs = build_pairs(one, only, FAMILIES, 3, 5)
    assert sorted((r.job_id, r.relevance) for r in pairs.collect()) == [(1, 1), (2, 1)]
    assert build_pairs(one.filter("false"), only).count() == 0


def test_build_pairs_many_categories(spark):
    """3,000 categories, each title in two of them: more than any pattern would take."""
    n = 3000
    jobs = spark.range(2 * n).select(
        F.col("id").alias("job_id"), F.format_string("maker of w%d and w%d", F.col("id") % n, (F.col("id") * 7 + 1) % n).alias("job_title")
    )
    people = spark.range(n).select(F.col("id").alias("resume_id"), F.format_string("W%d", "id").alias("resume_category"))
    found = build_pairs(people, jobs, {}, 3, 2, categories=extra_categories(people, {}))
    titles = {r.job_id: set(r.job_title.split()) for r in jobs.collect()}
    drawn = defaultdict(list)
    for r in found.collect():
        assert (r.resume_category.lower() in titles[r.job_id]) == bool(r.relevance)
        drawn[r.resume_id].append((r.relevance, r.job_id))
    assert len(drawn) == n
    assert all(len(set(d)) == 8 and Counter(x for x, _ in d) == {1: 2, 0: 6} for d in drawn.values())
    again = build_pairs(people.repartition(5), jobs.repartition(3), {}, 3, 2, categories=extra_categories(people, {}))
    assert rows(again) == rows(found)


def test_samples_move_no_text(spark):
    """A split compares each row with its stratum's cut where it is: no text in any exchange, ties exact."""
    df = spark.range(3000).select(
        F.lit(1).alias("resume_id"), F.col("id").alias("job_id"), (F.col("id") % 3).alias("relevance"), F.repeat(F.lit("x"), 10).alias("body")
    )
    for side in (*holdout_rows(df, ["job_id"], "relevance"), *holdout(df.withColumn("resume_id", F.col("job_id") % 9))):
        assert side.count() > 0
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange hash" in line or "Exchange range" in line for line in plan.splitlines())
    copies = df.withColumn("job_id", F.lit(5))
    train, held = holdout_rows(copies, ["job_id"], "relevance", 0.2)
    assert (train.count(), held.count()) == (2400, 600)
    nothing = df.withColumn("relevance", F.lit(None).cast("long"))
    train, held = holdout_rows(nothing, ["job_id"], "relevance", 0.2)
    assert (train.count(), held.count()) == (2400, 600)
    ranked = with_hash_position(df.select("job_id", "relevance"), ["job_id"], ["relevance"]).filter("position <= 200")
    assert {r.job_id for r in holdout_rows(df, ["job_id"], "relevance")[1].collect()} == {r.job_id for r in ranked.collect()}


@pytest.mark.parametrize("groups", [2, 7, 50])
def test_group_holdout(spark, groups):
    df = spark.range(200).select((F.col("id") % groups).alias("resume_id"), F.col("id").alias("job_id"), F.lit(1).alias("relevance"))
    train, held = holdout(df, 0.2)
    sides = [{r.resume_id for r in side.select("resume_id").distinct().collect()} for side in (train, held)]
    assert not sides[0] & sides[1] and len(sides[1]) == math.ceil(0.2 * groups)
    assert train.count() + held.count() == 200
    assert rows(held) == rows(holdout(df.repartition(5), 0.2)[1])


def test_row_holdout(spark):
    df = spark.range(101).select(F.lit(1).alias("resume_id"), F.col("id").alias("job_id"), (F.col("id") % 4 == 0).cast("int").alias("relevance"))
    train, held = holdout(df, 0.2)
    assert held.count() == 21 and train.count() == 80
    sizes = {r.relevance: (r.n, r.n_eval) for r in strata_sizes(df, "relevance", 0.2).collect()}
    assert sizes[0][0] == 75 and sizes[1][0] == 26 and sizes[0][1] + sizes[1][1] == 21
    assert {r.relevance: r.n for r in held.groupBy("relevance").agg(F.count("*").alias("n")).collect()} == {k: v[1] for k, v in sizes.items()}
    empty = holdout(df.filter("false"), 0.2)
    assert [side.count() for side in empty] == [0, 0]
    assert holdout_rows(df, ["job_id"], "relevance", 1.0)[0].count() == 0


@pytest.mark.parametrize(
    "sizes, target, floor, want",
    [
        ({"BIG": 1000, "RARE": 3}, 100, 200, {"BIG": 200, "RARE": 3}),
        ({"A": 500, "B": 500, "C": 500}, 300, 50, {"A": 100, "B": 100, "C": 100}),
        ({"A": 200, "B": 200, "C": 5}, 100, 10, {"A": 49, "B": 49, "C": 5}),
    ],
)
def test_stratified_sample(spark, sizes, target, floor, want):
    data = [(f, i) for f, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(data)], "job_id long, job_family string")
    assert {r.job_family: r.n_sample for r in sample_sizes(df, "job_family", target, floor).collect()} == want
    sample = stratified_sample(df, "job_family", target, floor)
    assert {r.job_family: r["count"] for r in sample.groupBy("job_family").count().collect()} == want
    assert sample.select("job_id").distinct().count() == sum(want.values())
    assert rows(sample) == rows(stratified_sample(df.repartition(6), "job_family", target, floor))


def test_keep_first_newest_page(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 2), (2, "a", 4)], "k int, t string, o int")
    assert rows(keep_first(df, ["k", "t"], ["o"])) == [(1, "a", 1), (1, "b", 2), (2, "a", 4)]
    runs = spark.createDataFrame([(u, t) for u in (1, 2) for t in range(u * 5)], "user_id int, t int")
    assert rows(keep_newest(runs.filter("user_id = 1"), ["user_id"], ["t"], 3)) == [(1, 2), (1, 3), (1, 4)]
    assert rows(quota_overflow(runs, ["user_id"], 7)) == [(1, 0), (2, 3)]
    page = page_of(runs, ["user_id"], ["t"], 2, 4)
    assert sorted((r.user_id, r.t, r.position) for r in page.collect()) == [(1, 0, 5), (2, 2, 8), (2, 3, 7), (2, 4, 6), (2, 5, 5)]
    fresh = page_of(runs, ["user_id"], ["t"], 2, 4)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # cut before and after the shuffle
