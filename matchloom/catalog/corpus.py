"""Queries over cleaning, labelling, pairing, splitting and sampling.

Parts stand in for postings (short titles) and customers for resumes (a segment as category).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from matchloom.catalog.registry import query, r6, sql_normalize, table, texts
from matchloom.catalog.text import PART_FAMILIES, PART_SQL_FAMILY, PART_SQL_NAMES
from matchloom.functions.taxonomy import derive_family
from matchloom.functions.text import normalize_text
from matchloom.operators.metrics import corpus_summary
from matchloom.operators.layout import checkpointed
from matchloom.operators.phrase_match import find_categories
from matchloom.operators.ranking import keep_first, with_dense_id
from matchloom.operators.sampling import (
    build_pairs, category_matches, group_sides, holdout_groups, holdout_rows, sample_sizes, strata_sizes, stratified_sample,
)
from matchloom.plans.corpus import clean_postings, clean_resumes, demo_corpus
from matchloom.sources.tables import shared_folder

# Test taxonomy: customer segments as categories, words of part names as their keywords.
SEGMENTS = {
    "BUILDING": ("rod", "anvil"),
    "AUTOMOBILE": ("gear", "red ring", "hot bolt"),
    "MACHINERY": ("gizmo", "gear"),
    "HOUSEHOLD": ("plate",),
}
_SQL_SEGMENTS = ", ".join(
    f"('{c}', regexp_matches(n, '(^| )({'|'.join(k)})( |$)'))" for c, k in {**SEGMENTS, "FURNITURE": ("furniture",)}.items()
)
_SQL_MATCHED = f"n AS ({PART_SQL_NAMES})," + """ m AS (SELECT p_partkey, category, hit FROM n, LATERAL (VALUES """ + _SQL_SEGMENTS + """) v(category, hit))"""
_SQL_COUNTS = f"""{_SQL_MATCHED},
s AS (SELECT category, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM m GROUP BY category),
c AS (SELECT c_custkey, c_mktsegment AS category, pos, least(pos, 2) AS n_pos, least(neg, greatest(1, least(pos, 2)) * 3) AS n_neg
  FROM customer JOIN s ON s.category = c_mktsegment WHERE pos > 0)"""


def _titles(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("job_title"))


def _resumes(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("resume_id"), F.col("c_mktsegment").alias("resume_category")
    )


def _pairs(spark, sf):
    return build_pairs(_resumes(spark, sf), _titles(spark, sf), SEGMENTS, 3, 2, unicode=False)


@query(
    "dedup_first",
    f"""SELECT min(doc_id) AS doc_id, lang, md5({sql_normalize('text')}) AS digest FROM documents
WHERE {sql_normalize('text')} <> '' GROUP BY lang, md5({sql_normalize('text')})""",
)
def dedup_first(spark, sf):
    hashed = texts(spark, sf, "documents").withColumn("norm", normalize_text("text", unicode=False)).filter("norm <> ''")
    hashed = hashed.select("doc_id", "lang", F.md5("norm").alias("digest"))
    return keep_first(hashed, ["lang", "digest"], ["doc_id"])


@query("dense_ids", "SELECT p_partkey, p_partkey + 1 AS id FROM part")
def dense_ids(spark, sf):
    return with_dense_id(table(spark, sf, "part").select("p_partkey"), "id")


@query("dense_ids_files", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey % 5, l_orderkey, l_linenumber) AS id FROM lineitem")
def dense_ids_files(spark, sf):
    """Five folders of files, in order of a key that isn't the tables': ids follow the paths and the rows in each file."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5).alias("piece"))
    path = shared_folder(spark, f"pieces-{uuid.uuid4().hex}")
    keys = ["piece", "l_orderkey", "l_linenumber"]
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)  # ranges, and with them tasks, of bounded size
    ordered.write.partitionBy("piece").parquet(path)
    return with_dense_id(spark.read.parquet(path), "id").select("l_orderkey", "l_linenumber", "id")


@query(
    "pair_counts_categories",
    """WITH c AS (SELECT p_partkey, upper(w) AS category FROM (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part)),
s AS (SELECT category, count(*) AS hits FROM c GROUP BY category),
r AS (SELECT s.category, hits, (SELECT count(*) FROM part) - hits AS misses FROM s)
SELECT category, CAST(sum(n_pos) AS BIGINT) AS positives, CAST(sum(n_neg) AS BIGINT) AS negatives FROM (
  SELECT category, least(hits, 2) AS n_pos, least(misses, 3 * least(hits, 2)) AS n_neg FROM r JOIN (SELECT c_custkey FROM customer) ON true
  WHERE c_custkey % (SELECT count(*) FROM s) = (SELECT count(*) FROM s t WHERE t.category < r.category)) GROUP BY category""",
)
def pair_counts_categories(spark, sf):
    """Every word of the titles is a category of its own; no taxonomy of patterns."""
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.lower("p_name").alias("job_title"))
    words = titles.select(F.explode(F.split("job_title", " ")).alias("keyword")).distinct()
    names = words.select("keyword", F.upper("keyword").alias("category")).withColumn(
        "rank", F.row_number().over(W.orderBy("category")).cast("long") - 1  # words of a fixed vocabulary
    )
    n = names.agg(F.count(F.lit(1)).alias("n")).scalar()
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"), F.pmod("c_custkey", n).alias("rank"))
    people = people.join(names, "rank").select("resume_id", F.col("category").alias("resume_category"))
    pairs = build_pairs(people, titles, {}, 3, 2, unicode=False, categories=names.select("category", "keyword"))
    return pairs.groupBy(F.col("resume_category").alias("category")).agg(
        F.sum("relevance").alias("positives"), F.sum(1 - F.col("relevance")).alias("negatives")
    )


@query(
    "clean_postings",
    f"""WITH d AS (SELECT doc_id // 2 AS job_id, doc_id, source, lang, text, trim(concat_ws(' ', {sql_normalize('source')},
    nullif({sql_normalize('text')}, ''), {sql_normalize('lang')})) AS body FROM documents),
f AS (SELECT * FROM d WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY job_id, body ORDER BY doc_id) = 1)
SELECT job_id, source AS job_title, lang AS skills, body AS text, upper(replace({sql_normalize('source')}, ' ', '-')) AS job_category,
  CASE WHEN regexp_matches({sql_normalize('source')}, '(^| )(web|forum)( |$)') THEN 'NET' ELSE 'OTHER' END AS job_family FROM f""",
)
def clean_postings_documents(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 2).cast("string").alias("job_id"), F.col("source").alias("title"),
        F.col("text").alias("description"), F.col("lang").alias("skills"),
    )
    return clean_postings(raw, {"NET": ("web", "forum")}, unicode=False).drop("description")


@query(
    "clean_resumes",
    f"""SELECT conv_id AS resume_id, min_by(role, turn) AS category, upper(min_by(role, turn)) AS resume_category, body AS text
FROM (SELECT *, {sql_normalize('text')} AS body FROM conversations) WHERE body <> '' GROUP BY conv_id, body""",
)
def clean_resumes_conversations(spark, sf):
    raw = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("resume_id"), F.col("role").alias("category"), F.col("text").alias("resume_text")
    )
    return clean_resumes(raw, unicode=False).drop("resume_text_raw")


@query(
    "category_matches",
    f"WITH {_SQL_MATCHED} SELECT p_partkey AS job_id, category FROM m WHERE hit",
)
def category_matches_parts(spark, sf):
    matched = category_matches(_titles(spark, sf), {**SEGMENTS, "FURNITURE": ("furniture",)}, unicode=False)
    return matched.select("job_id", "category")


@query(
    "pair_counts",
    f"""WITH {_SQL_COUNTS} SELECT c_custkey AS resume_id, category AS resume_category, n_pos AS positives, n_neg AS negatives,
  n_pos + n_neg AS distinct_jobs FROM c""",
)
def pair_counts(spark, sf):
    return _pairs(spark, sf).groupBy("resume_id", "resume_category").agg(
        F.sum("relevance").alias("positives"),
        F.sum(1 - F.col("relevance")).alias("negatives"),
        F.countDistinct("job_id").alias("distinct_jobs"),
    )


@query(
    "pair_labels",
    f"WITH {_SQL_COUNTS} SELECT category AS resume_category, CAST(sum(n_pos) AS BIGINT) AS right_positives, CAST(sum(n_neg) AS BIGINT) AS right_negatives FROM c GROUP BY 1",
)
def pair_labels(spark, sf):
    """Every drawn label checked against the title: all of them must be right."""
    titles = _titles(spark, sf)
    checked = _pairs(spark, sf).join(titles, "job_id")
    hits = category_matches(titles, SEGMENTS, unicode=False).select("job_id", F.col("category").alias("resume_category"), F.lit(1).alias("truth"))
    labelled = checked.join(hits, ["job_id", "resume_category"], "left").withColumn("truth", F.coalesce("truth", F.lit(0)))
    return labelled.groupBy("resume_category").agg(
        F.count_if((F.col("relevance") == 1) & (F.col("truth") == 1)).alias("right_positives"),
        F.count_if((F.col("relevance") == 0) & (F.col("truth") == 0)).alias("right_negatives"),
    )


@query(
    "group_split_sizes",
    """WITH g AS (SELECT count(DISTINCT o_custkey) AS n, count(*) AS row_count FROM orders)
SELECT n AS groups, CAST(ceil(0.2 * n) AS BIGINT) AS eval_groups, 0::BIGINT AS split_groups, row_count FROM g""",
)
def group_split_sizes(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    train, held = holdout_groups(orders, 0.2, "o_custkey")
    sides = train.withColumn("e", F.lit(0)).unionByName(held.withColumn("e", F.lit(1)))
    per_group = sides.groupBy("o_custkey").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count(F.lit(1)).alias("n"))
    return per_group.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("hi") == 1).alias("eval_groups"),
        F.count_if(F.col("lo") != F.col("hi")).alias("split_groups"), F.sum("n").alias("row_count"),
    )


@query("group_sides")
def group_sides_orders(spark, sf):
    return group_sides(table(spark, sf, "orders"), "o_custkey")


_SQL_STRATA = """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
t AS (SELECT *, sum(n) OVER () AS total FROM c), q AS (SELECT *, total - ceil(0.25 * total) AS train FROM t),
f AS (SELECT *, n * train / total AS quota, floor(n * train / total) AS low FROM q),
x AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY quota - low DESC, quality) <= train - sum(low) OVER () THEN 1 ELSE 0 END AS extra FROM f)
SELECT quality, n, CAST(n - low - extra AS BIGINT) AS n_eval FROM x"""


@query("row_split_sizes", _SQL_STRATA)
def row_split_sizes(spark, sf):
    train, held = holdout_rows(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 0.25)
    n_train = train.groupBy("quality").agg(F.count(F.lit(1)).alias("t"))
    n_eval = held.groupBy("quality").agg(F.count(F.lit(1)).alias("n_eval"))
    return n_train.join(n_eval, "quality").select("quality", (F.col("t") + F.col("n_eval")).alias("n"), "n_eval")


@query("strata_sizes", _SQL_STRATA)
def strata_sizes_labels(spark, sf):
    return strata_sizes(table(spark, sf, "labels"), "quality", 0.25)


_SQL_SIZES = """WITH c AS (SELECT {by} AS stratum, count(*) AS n FROM {table} GROUP BY 1)
SELECT stratum, n, least(n, greatest(CAST(round_even({target} * n::DOUBLE / (SELECT count(*) FROM {table}), 0) AS BIGINT), {floor})) AS n_sample FROM c"""


@query("stratified_sizes", _SQL_SIZES.format(by="lang", table="documents", target=300, floor=40))
def stratified_sizes(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    sample = stratified_sample(documents, "lang", 300, 40, key="doc_id").groupBy("lang").agg(F.countDistinct("doc_id").alias("n_sample"))
    return documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(sample, "lang").withColumnRenamed("lang", "stratum")


@query("sample_sizes", _SQL_SIZES.format(by="p_type", table="part", target=700, floor=118))
def sample_sizes_part(spark, sf):
    return sample_sizes(table(spark, sf, "part"), "p_type", 700, 118).withColumnRenamed("p_type", "stratum")


@query(
    "demo_corpus",
    f"""WITH n AS ({PART_SQL_NAMES}), f AS (SELECT {PART_SQL_FAMILY} AS job_family, count(*) AS n FROM n GROUP BY 1)
SELECT job_family, least(n, greatest(CAST(round_even(500 * n::DOUBLE / (SELECT count(*) FROM part), 0) AS BIGINT), 100)) AS rows,
  least(n, greatest(CAST(round_even(500 * n::DOUBLE / (SELECT count(*) FROM part), 0) AS BIGINT), 100)) AS rebuilt, 5 AS longest FROM f""",
)
def demo_corpus_parts(spark, sf):
    """Descriptions are cut to five characters; ``text`` must be the title plus the cut description."""
    postings = table(spark, sf, "part").select(
        F.col("p_partkey").alias("job_id"), F.col("p_name").alias("job_title"),
        F.concat(F.lit("Brand "), F.col("p_brand")).alias("description"), F.lit("x").alias("skills"),
    )
    demo = demo_corpus(postings, 500, 100, 5, taxonomy=PART_FAMILIES, unicode=False)
    expected = F.concat(F.col("job_title"), F.lit(" brand x"))
    return demo.groupBy("job_family").agg(
        F.countDistinct("job_id").alias("rows"), F.count_if(F.col("text") == expected).alias("rebuilt"),
        F.max(F.length("description")).alias("longest"),
    )


@query(
    "corpus_summary",
    f"""WITH {_SQL_COUNTS}, f AS (SELECT {PART_SQL_FAMILY} AS family, n FROM n)
SELECT (SELECT count(*) FROM f) AS jobs, (SELECT round(avg((family <> 'OTHER')::INT), 6) FROM f) AS family_coverage,
  (SELECT count(DISTINCT n) FROM f) AS job_categories, (SELECT count(*) FROM customer) AS resumes,
  (SELECT count(DISTINCT c_mktsegment) FROM customer) AS resume_categories, (SELECT CAST(sum(n_pos + n_neg) AS BIGINT) FROM c) AS pairs,
  (SELECT round(sum(n_pos) / sum(n_pos + n_neg), 6) FROM c) AS positive_rate""",
)
def corpus_summary_parts(spark, sf):
    titles = _titles(spark, sf)
    jobs = titles.withColumn("job_family", derive_family("job_title", PART_FAMILIES, unicode=False)).withColumn(
        "job_category", F.upper("job_title")
    )
    summary = corpus_summary(jobs, _resumes(spark, sf), checkpointed(_pairs(spark, sf)))
    return summary.withColumn("family_coverage", r6("family_coverage")).withColumn("positive_rate", r6("positive_rate"))


@query(
    "category_phrases",
    """SELECT DISTINCT p.p_partkey AS job_id, c.category FROM part p
JOIN (SELECT DISTINCT p_brand AS category, lower(p_name) AS keyword FROM part) c
  ON contains(' ' || lower(p.p_name) || ' ', ' ' || c.keyword || ' ')""",
)
def category_phrases(spark, sf):
    categories = table(spark, sf, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("keyword"))
    return find_categories(_titles(spark, sf), categories, unicode=False).select("job_id", "category")
