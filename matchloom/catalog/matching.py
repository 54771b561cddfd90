"""Queries over vectors, matching, explanation and evaluation.

Postings are the documents that have a vector; every one of them is also a request. A posting's
family is its vector's label, and a label shared with the request is the relevance truth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.catalog.registry import (
    LEXICON, join_text, query, r6, sql_digest, sql_skills, sql_squeeze, sql_tokens, table, texts,
)
from matchloom.functions.skills import extract_skills
from matchloom.functions.text import SCORING_TEXT_CHARS, tokens
from matchloom.operators.encoding import HASHING_MODEL, dot, encode_incremental, hashing_encoder
from matchloom.operators.filters import apply_filters, effective_k
from matchloom.operators.idf import build_idf
from matchloom.operators.key_filter import possible_rows
from matchloom.operators.layout import checkpointed, spread
from matchloom.operators.knn import knn_ann, knn_exact, knn_exact_unlike, read_cells, write_cells
from matchloom.operators.matching import explain, hydrate, lexical_scorer, shared_terms
from matchloom.operators.metrics import attach_truth, candidate_counts, mean_ndcg, ndcg, recall_at_k
from matchloom.operators.ranking import rank_by, rank_delta, sort_results
from matchloom.operators.runs import rank_movement, skill_difference, skill_gap, skill_set
from matchloom.plans.corpus import build_vectors
from matchloom.plans.evaluation import compare_systems
from matchloom.plans.matching import Matches, match, match_distinct, nested_results, retrieve, retrieve_results
from matchloom.sources.export import markdown_rows, write_markdown
from matchloom.sources.tables import shared_folder


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


def _queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def _family(label):
    return F.concat(F.lit("F"), label.cast("string"))


def _vector_texts(spark, sf, *columns):
    """Documents joined with their vector's ``columns``. The others are dropped where they are read: the plans read this
    several times, and each time the texts that stay are shuffled for the join."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), *columns)
    documents = table(spark, sf, "documents")
    return spread(possible_rows(documents, vectors, "doc_id"), documents).join(vectors, "doc_id")


def _postings(spark, sf):
    return _vector_texts(spark, sf, "label").select(
        F.col("doc_id").alias("job_id"),
        F.concat_ws(" ", "lang", "source").alias("job_title"),
        F.col("text").alias("description"),
        F.lit("").alias("skills"),
        "text",
        F.upper("source").alias("job_category"),
        _family(F.col("label")).alias("job_family"),
    )


def _requests(spark, sf):
    """Every posting as a request; even labels filter on two families, odd ones on none."""
    families = F.when(
        F.col("label") % 2 == 0, F.array(_family(F.col("label")), _family((F.col("label") + 1) % 10))
    )
    return _vector_texts(spark, sf, "label", F.col("embedding").alias("vec")).select(
        F.col("doc_id").alias("query_id"),
        F.col("text").alias("query_text"),
        F.lit(20).alias("top_k"),
        F.lit(5).alias("top_n"),
        families.alias("job_families"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(0.999)).alias("min_score"),
        F.lit(True).alias("explain"),
        "vec",
    )


def _match(spark, sf, chars=SCORING_TEXT_CHARS):
    postings = _postings(spark, sf)
    idf = build_idf(postings, chars=chars)
    return match(_requests(spark, sf), postings, _vectors(spark, sf), idf, lexicon=LEXICON, chars=chars)


# SQL building blocks -----------------------------------------------------------------------------

_SQL_PAIRS = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, q.label AS q_label, v.label AS v_label,
  round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q, embeddings v)"""
_SQL_RANKED = f"""{_SQL_PAIRS},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS retrieval_rank FROM pairs)"""
_SQL_POSTINGS = "postings AS (SELECT d.doc_id, d.text, d.lang, d.source, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"


def _sql_cap(text: str, chars: int | None) -> str:
    return text if chars is None else f"substring({text}, 1, {chars})"


def _sql_idf(chars: int | None = SCORING_TEXT_CHARS) -> str:
    return f"""idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM postings)) / (1.0 + count(*))) + 1.0 AS idf
  FROM (SELECT doc_id, unnest(list_distinct({sql_tokens(_sql_cap('text', chars))})) AS term FROM postings) GROUP BY term
  ORDER BY count(*) DESC, term LIMIT 50000)"""


def _sql_match(chars: int | None = SCORING_TEXT_CHARS) -> str:
    return f"""{_SQL_RANKED}, {_SQL_POSTINGS}, {_sql_idf(chars)},
candidates AS (SELECT r.* FROM ranked r SEMI JOIN postings q ON q.doc_id = r.query_id SEMI JOIN postings j ON j.doc_id = r.item_id
  WHERE retrieval_rank <= CASE WHEN q_label % 2 = 0 THEN 60 ELSE 20 END),
eligible AS (SELECT * FROM candidates WHERE q_label % 2 = 1 OR v_label IN (q_label, (q_label + 1) % 10)),
qterms AS MATERIALIZED (SELECT doc_id AS query_id, list_distinct({sql_tokens('text')}) AS terms FROM postings),
jterms AS MATERIALIZED (SELECT doc_id AS item_id, list_distinct({sql_tokens(_sql_cap(sql_squeeze('text'), chars))}) AS terms FROM postings),
common AS (SELECT e.query_id, e.item_id, unnest(list_intersect(q.terms, j.terms)) AS term
  FROM eligible e JOIN qterms q USING (query_id) JOIN jterms j ON j.item_id = e.item_id),
sums AS (SELECT query_id, item_id, sum(i.idf) AS s FROM common JOIN idf i USING (term) GROUP BY 1, 2),
scored AS (SELECT e.*, round(coalesce(s.s, 0.0), 6) AS cross_score FROM eligible e LEFT JOIN sums s USING (query_id, item_id)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, retrieval_rank) AS rank FROM scored),
survivors AS (SELECT * FROM reranked WHERE query_id % 2 = 1 OR 1.0 / (1.0 + exp(-cross_score)) >= 0.999),
shown AS (SELECT * FROM survivors WHERE rank <= 5)"""


def _sql_explain(chars: int | None = SCORING_TEXT_CHARS) -> str:
    return f"""{_sql_match(chars)},
lex AS (SELECT doc_id, {sql_skills(_sql_cap('text', chars))} AS skills,
  list_distinct({sql_tokens(_sql_cap('text', chars))}) AS terms FROM postings),
sided AS (SELECT s.query_id, s.item_id, s.rank, q.skills AS q_skills, j.skills AS j_skills, q.terms AS q_terms, j.terms AS j_terms
  FROM shown s JOIN lex q ON q.doc_id = s.query_id JOIN lex j ON j.doc_id = s.item_id),
matched AS (SELECT *, list_sort(list_filter(j_skills, lambda x: list_contains(q_skills, x))) AS matched_skills,
  list_filter(j_skills, lambda x: NOT list_contains(q_skills, x)) AS lost FROM sided),
missing AS (SELECT query_id, item_id, string_agg(skill, '|' ORDER BY coalesce(i.idf, 0) DESC, skill) AS missing_skills
  FROM (SELECT query_id, item_id, unnest(lost) AS skill FROM matched) m LEFT JOIN idf i ON i.term = m.skill GROUP BY 1, 2),
best AS (SELECT query_id, item_id, m.term, i.idf, row_number() OVER (PARTITION BY query_id, item_id ORDER BY i.idf DESC, m.term) AS place
  FROM (SELECT query_id, item_id, unnest(list_filter(q_terms, lambda x: list_contains(j_terms, x))) AS term FROM sided) m
  JOIN idf i ON i.term = m.term WHERE i.idf >= 1.0),
top_terms AS (SELECT query_id, item_id, string_agg(term, '|' ORDER BY place) AS matched_terms, round(sum(idf), 6) AS weight
  FROM best WHERE place <= 12 GROUP BY 1, 2),
explained AS (SELECT m.query_id, m.item_id AS job_id, m.rank, array_to_string(m.matched_skills, '|') AS matched_skills,
  coalesce(x.missing_skills, '') AS missing_skills, coalesce(t.matched_terms, '') AS matched_terms, coalesce(t.weight, 0.0) AS weight,
  round(len(m.matched_skills) / greatest(1, len(m.j_skills)), 6) AS overlap_score, m.matched_skills AS matched_list, m.lost
  FROM matched m LEFT JOIN missing x USING (query_id, item_id) LEFT JOIN top_terms t USING (query_id, item_id))"""


_SQL_IDF, _SQL_MATCH, _SQL_EXPLAIN = _sql_idf(), _sql_match(), _sql_explain()


# Retrieval ---------------------------------------------------------------------------------------


@query(
    "knn_exact",
    f"WITH {_SQL_RANKED} SELECT query_id, item_id, score, retrieval_rank FROM ranked WHERE retrieval_rank <= 10",
)
def knn_exact_all(spark, sf):
    return knn_exact(_queries(spark, sf), _vectors(spark, sf), 10)


@query("knn_ann")
def knn_ann_all(spark, sf):
    return knn_ann(_queries(spark, sf), _vectors(spark, sf), 10)


@query("knn_ann_recall", "SELECT count(*) AS queries, true AS recall_is_090 FROM embeddings")
def knn_ann_recall(spark, sf):
    """Mean recall of the approximate search as ``knn_ann`` runs it."""
    recall = recall_at_k(knn_ann_all(spark, sf), knn_exact_all(spark, sf))
    return recall.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recall_is_090"))


_SQL_TOP10 = f"WITH {_SQL_RANKED} SELECT query_id, item_id, score, retrieval_rank FROM ranked WHERE retrieval_rank <= 10"


@query("knn_ann_all_cells", _SQL_TOP10)
def knn_ann_all_cells(spark, sf):
    """The approximate search is the exact one when it visits every cell."""
    return knn_ann(_queries(spark, sf), _vectors(spark, sf), 10, nprobe=10**6)


@query("knn_stored_cells", _SQL_TOP10)
def knn_stored_cells(spark, sf):
    """Exact search over an index that was written once and read back."""
    path = shared_folder(spark, f"cells-{uuid.uuid4().hex}")
    write_cells(_vectors(spark, sf), path)
    return knn_exact(_queries(spark, sf), read_cells(spark, path), 10)


@query(
    "knn_overfetch_family",
    f"""WITH {_SQL_RANKED},
deep AS (SELECT r.* FROM ranked r SEMI JOIN documents q ON q.doc_id = r.query_id
  WHERE retrieval_rank <= CASE WHEN q_label % 2 = 0 THEN 60 ELSE 20 END)
SELECT query_id, item_id, score, retrieval_rank FROM deep WHERE q_label % 2 = 1 OR v_label IN (q_label, (q_label + 1) % 10)""",
)
def knn_overfetch_family(spark, sf):
    requests = _requests(spark, sf)
    hits = knn_exact(_queries(spark, sf), _vectors(spark, sf), 60)
    own = requests.select("query_id", "job_families", effective_k("top_k", "job_families").alias("depth"))
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), _family(F.col("label")).alias("job_family"))
    candidates = hits.join(own, "query_id").filter("retrieval_rank <= depth").join(labels, "item_id")
    return apply_filters(candidates, F.col("job_families")).select("query_id", "item_id", "score", "retrieval_rank")


@query(
    "retrieval_rank",
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS retrieval_rank
FROM orders""",
)
def retrieval_rank(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rank_by(orders, "o_totalprice", ["o_orderkey"], ["o_custkey"]).drop("o_totalprice")


@query(
    "hydrate_hits",
    f"""WITH {_SQL_RANKED} SELECT r.query_id, r.item_id AS job_id, r.retrieval_rank, l.quality
FROM ranked r JOIN labels l ON l.doc_id = r.item_id WHERE r.retrieval_rank <= 10""",
)
def hydrate_hits(spark, sf):
    """Labels cover only some documents: hits on the others go, ranks stay."""
    hits = knn_exact(_queries(spark, sf), _vectors(spark, sf), 10).select("query_id", F.col("item_id").alias("job_id"), "retrieval_rank")
    return hydrate(hits, table(spark, sf, "labels").select(F.col("doc_id").alias("job_id"), "quality"))


@query(
    "retrieve_stage",
    f"""WITH {_SQL_RANKED}, {_SQL_POSTINGS},
kept AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_rank) AS rank FROM ranked r
  SEMI JOIN postings q ON q.doc_id = r.query_id SEMI JOIN postings j ON j.doc_id = r.item_id WHERE retrieval_rank <= 20)
SELECT query_id, item_id AS job_id, score AS bi_encoder_score, 0.0::DOUBLE AS cross_encoder_score,
  retrieval_rank, CAST(rank AS INTEGER) AS rank FROM kept WHERE rank <= 5""",
)
def retrieve_stage(spark, sf):
    return retrieve_results(_requests(spark, sf), _postings(spark, sf), _vectors(spark, sf)).drop("explanation")


# Matching ----------------------------------------------------------------------------------------


@query(
    "match_two_stage",
    f"""WITH {_SQL_MATCH} SELECT query_id, item_id AS job_id, score AS bi_encoder_score, cross_score AS cross_encoder_score,
  retrieval_rank, CAST(rank AS INTEGER) AS rank, CAST(retrieval_rank - rank AS BIGINT) AS rank_delta FROM shown""",
)
def match_two_stage(spark, sf):
    return rank_delta(_match(spark, sf).results.drop("explanation")).withColumn("rank_delta", F.col("rank_delta").cast("long"))


@query(
    "match_deep",
    f"""WITH {_SQL_MATCH} SELECT query_id, item_id AS job_id, cross_score AS cross_encoder_score, CAST(rank AS INTEGER) AS rank
FROM survivors WHERE rank <= 60""",
)
def match_deep(spark, sf):
    """More results per request than a page shows."""
    postings = _postings(spark, sf)
    requests = _requests(spark, sf).withColumn("top_n", F.lit(60)).withColumn("explain", F.lit(False))
    results = match(requests, postings, _vectors(spark, sf), build_idf(postings)).results
    return results.select("query_id", "job_id", "cross_encoder_score", "rank")


@query(
    "candidate_counts",
    f"""WITH {_SQL_MATCH} SELECT p.doc_id AS query_id, {sql_digest('p.text')} AS resume_hash,
  (SELECT count(*) FROM candidates c WHERE c.query_id = p.doc_id) AS total_candidates,
  (SELECT count(*) FROM survivors s WHERE s.query_id = p.doc_id) AS filtered_candidates FROM postings p""",
)
def candidate_counts_match(spark, sf):
    return _match(spark, sf).counts


@query(
    "survivor_counts",
    """SELECT o_custkey, count(*) AS total_candidates, count(*) FILTER (WHERE o_orderstatus = 'F') AS filtered_candidates
FROM orders GROUP BY o_custkey""",
)
def survivor_counts(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("survived"))
    return candidate_counts(orders, "o_custkey")


@query(
    "filter_scores",
    """SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')
  AND (o_orderkey % 10 = 0 OR 1.0 / (1.0 + exp(-((o_totalprice - 250000.0) / 100000.0))) >= 0.6)""",
)
def filter_scores(spark, sf):
    score = F.when(F.col("o_orderkey") % 10 != 0, (F.col("o_totalprice") - 250000.0) / 100000.0)
    orders = table(spark, sf, "orders").withColumn("cross_encoder_score", score)
    return apply_filters(orders, ["1-URGENT", "3-MEDIUM"], 0.6, "o_orderpriority").select("o_orderkey")


@query(
    "lexical_score",
    f"""WITH {_SQL_RANKED}, {_SQL_POSTINGS}, {_SQL_IDF},
wanted AS MATERIALIZED (SELECT query_id, item_id FROM ranked WHERE retrieval_rank <= CASE WHEN q_label % 2 = 0 THEN 60 ELSE 20 END
  AND (q_label % 2 = 1 OR v_label IN (q_label, (q_label + 1) % 10))),
eligible AS MATERIALIZED (SELECT w.* FROM wanted w SEMI JOIN postings q ON q.doc_id = w.query_id SEMI JOIN postings j ON j.doc_id = w.item_id),
asked AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM postings),
offered AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({sql_tokens(f"substring({sql_squeeze('text')}, 1, 1200)")})) AS term FROM postings),
sums AS MATERIALIZED (SELECT e.query_id, e.item_id, sum(i.idf) AS s FROM eligible e JOIN asked a ON a.doc_id = e.query_id
  JOIN offered o ON o.doc_id = e.item_id AND o.term = a.term JOIN idf i ON i.term = a.term GROUP BY 1, 2)
SELECT e.query_id, e.item_id AS job_id, round(coalesce(s.s, 0.0), 6) AS score FROM eligible e LEFT JOIN sums s USING (query_id, item_id)""",
)
def lexical_score(spark, sf):
    """The default pair score of every candidate that passes the family filter."""
    requests, postings = _requests(spark, sf), _postings(spark, sf)
    families = requests.select("query_id", "job_families")
    candidates = retrieve(requests, postings, _vectors(spark, sf)).join(families, "query_id")
    eligible = checkpointed(apply_filters(candidates, F.col("job_families")).select("query_id", "job_id"))
    scored = lexical_scorer(build_idf(postings))(eligible, requests.select("query_id", "query_text"), postings)
    return scored.withColumnRenamed("cross_encoder_score", "score")


@query(
    "shared_terms",
    f"""WITH {_SQL_RANKED}, {_SQL_POSTINGS}, {_SQL_IDF},
t AS (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM postings)
SELECT r.query_id, r.item_id AS job_id, count(*) AS n, round(sum(i.idf), 6) AS weight FROM ranked r
JOIN t a ON a.doc_id = r.query_id JOIN t b ON b.doc_id = r.item_id AND b.term = a.term JOIN idf i ON i.term = a.term
WHERE r.retrieval_rank <= 5 GROUP BY 1, 2""",
)
def shared_terms_pairs(spark, sf):
    postings = _postings(spark, sf)
    terms = postings.select("job_id", F.array_distinct(tokens("text")).alias("terms"))
    hits = knn_exact(_queries(spark, sf), _vectors(spark, sf), 5).select("query_id", F.col("item_id").alias("job_id"))
    pairs = hits.join(terms.withColumnRenamed("terms", "job_terms"), "job_id").join(
        terms.select(F.col("job_id").alias("query_id"), F.col("terms").alias("query_terms")), "query_id"
    )
    return shared_terms(pairs, build_idf(postings)).groupBy("query_id", "job_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("idf")).alias("weight")
    )


def _explained(spark, sf, chars=SCORING_TEXT_CHARS):
    results = _match(spark, sf, chars).results
    e = F.col("explanation")
    return results.select(
        "query_id", "job_id", "rank",
        e["matched_skills"].alias("matched_skills"), e["missing_skills"].alias("missing_skills"),
        e["matched_terms"].alias("matched_terms"), e["overlap_score"].alias("overlap_score"),
    )


@query(
    "explain_matches",
    f"""WITH {_sql_explain(None)} SELECT query_id, job_id, matched_skills, missing_skills, matched_terms, weight, overlap_score FROM explained""",
)
def explain_matches(spark, sf):
    """Term weights, scores and explanations over whole texts."""
    total = F.aggregate(F.transform("matched_terms", lambda t: t["weight"]), F.lit(0.0), lambda a, x: a + x)
    return _explained(spark, sf, None).select(
        "query_id",
        "job_id",
        join_text("matched_skills").alias("matched_skills"),
        join_text("missing_skills").alias("missing_skills"),
        join_text(F.transform("matched_terms", lambda t: t["term"])).alias("matched_terms"),
        r6(total).alias("weight"),
        r6("overlap_score").alias("overlap_score"),
    )


@query(
    "skill_gap",
    f"""WITH {_SQL_EXPLAIN}, g AS (SELECT query_id, unnest(lost) AS skill FROM explained WHERE rank <= 10),
n AS (SELECT query_id, skill, count(*) AS n FROM g GROUP BY 1, 2)
SELECT query_id, skill, n FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, skill) <= 8""",
)
def skill_gaps(spark, sf):
    return skill_gap(_explained(spark, sf))


@query(
    "result_rows",
    f"""WITH {_SQL_EXPLAIN} SELECT s.query_id, s.item_id AS job_id, p.lang || ' ' || p.source AS job_title,
  CAST(length(substring(p.text, 1, 1200)) AS INTEGER) AS description_chars, 'F' || p.label AS job_family, s.score AS bi_encoder,
  round(1.0 / (1.0 + exp(-s.cross_score)), 6) AS probability, x.overlap_score AS skill_overlap, CAST(s.rank AS INTEGER) AS rank
FROM shown s JOIN postings p ON p.doc_id = s.item_id JOIN explained x ON x.query_id = s.query_id AND x.job_id = s.item_id""",
)
def result_rows(spark, sf):
    nested = nested_results(_match(spark, sf).results, _postings(spark, sf))
    m = F.col("match")
    return nested.select(
        "query_id", m["job_id"].alias("job_id"), m["job_title"].alias("job_title"),
        F.length(m["description"]).alias("description_chars"), m["job_family"].alias("job_family"),
        m["scores"]["bi_encoder"].alias("bi_encoder"), r6(m["scores"]["cross_encoder_probability"]).alias("probability"),
        r6(m["scores"]["skill_overlap"]).alias("skill_overlap"), m["rank"].alias("rank"),
    )


def _sql_sorted(column: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {column} DESC, o_orderkey) AS INTEGER)"


@query(
    "sort_modes",
    f"""WITH o AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 1000.0) AS a, o_orderkey % 7 AS b, o_orderkey % 3 AS c FROM orders)
SELECT o_custkey, o_orderkey, {_sql_sorted('a')} AS relevance, {_sql_sorted('b')} AS semantic, {_sql_sorted('c')} AS coverage FROM o""",
)
def sort_modes(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 1000.0).alias("cross_encoder_probability"),
        (F.col("o_orderkey") % 7).alias("bi_encoder"), (F.col("o_orderkey") % 3).alias("skill_overlap"),
    )
    for mode, name in (("relevance", "relevance"), ("semantic", "semantic"), ("skill_coverage", "coverage")):
        o = sort_results(o, mode, ["o_custkey"], "o_orderkey").withColumnRenamed("position", name)
    return o.select("o_custkey", "o_orderkey", "relevance", "semantic", "coverage")


@query(
    "export_markdown",
    """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '|') AS title, p_size, p_retailprice / 10000.0 AS a, p_size / 51.0 AS b FROM part)
SELECT p_partkey, concat('| ', p_size, ' | ', replace(title, '|', '\\|'), ' | Promo Part | ',
  printf('%.1f', floor(a * 100.0 * 10 + 0.5) / 10), '% | ', printf('%.1f', floor(b * 100.0 * 10 + 0.5) / 10), '% |') AS line FROM p""",
)
def export_markdown(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("rank"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("job_title"),
        F.lit("PROMO_PART").alias("job_family"), (F.col("p_retailprice") / 10000.0).alias("cross_encoder_probability"),
        (F.col("p_size") / 51.0).alias("bi_encoder"),
    )
    return markdown_rows(part).select("p_partkey", "line")


@query(
    "markdown_table",
    """WITH p AS (SELECT p_size % 7 AS q, p_partkey, replace(p_name, ' ', '|') AS title, p_size, p_retailprice / 10000.0 AS a, p_size / 51.0 AS b FROM part),
l AS (SELECT concat('| ', p_partkey, ' | ', replace(title, '|', '\\|'), ' | Promo Part | ',
  printf('%.1f', floor(a * 100.0 * 10 + 0.5) / 10), '% | ', printf('%.1f', floor(b * 100.0 * 10 + 0.5) / 10), '% |') AS line FROM p),
q AS (SELECT DISTINCT q FROM p)
SELECT line, count(*) AS n FROM (SELECT line FROM l
  UNION ALL SELECT '| Rank | Job title | Family | Relevance | Semantic match |' FROM q UNION ALL SELECT '|---|---|---|---|---|' FROM q
  UNION ALL SELECT concat('<!-- ', q, ' -->') FROM q UNION ALL SELECT '' FROM q) GROUP BY line""",
)
def markdown_table(spark, sf):
    """The written tables, read back line by line."""
    part = table(spark, sf, "part").select(
        (F.col("p_size") % 7).alias("query_id"), F.col("p_partkey").alias("rank"), F.lit("PROMO_PART").alias("job_family"),
        F.replace("p_name", F.lit(" "), F.lit("|")).alias("job_title"),
        (F.col("p_retailprice") / 10000.0).alias("cross_encoder_probability"), (F.col("p_size") / 51.0).alias("bi_encoder"),
    )
    path = shared_folder(spark, f"markdown-{uuid.uuid4().hex}")
    write_markdown(markdown_rows(part), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "match_distinct",
    f"""WITH {_SQL_RANKED}, c AS (SELECT 1000000 * turn + conv_id AS query_id,
  (conv_id + turn * 7919) % (SELECT count(*) FROM embeddings) AS vec_id FROM conversations),
keyed AS (SELECT c.query_id, first_value(c.vec_id) OVER (PARTITION BY {sql_digest('d.text')} ORDER BY c.query_id) AS vec_id
  FROM c JOIN documents d ON d.doc_id = c.vec_id)
SELECT k.query_id, r.item_id AS job_id, r.score AS bi_encoder_score, r.retrieval_rank FROM keyed k
JOIN ranked r ON r.query_id = k.vec_id AND r.retrieval_rank <= 5 SEMI JOIN documents d ON d.doc_id = r.item_id""",
)
def match_distinct_requests(spark, sf):
    """Every turn asks one of all the texts with a vector: each distinct one is matched once, for every asker."""
    documents = texts(spark, sf, "documents").select(F.col("doc_id").alias("_d"), F.col("text").alias("query_text"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_d"), F.col("embedding").alias("vec"))
    many = vectors.agg(F.count(F.lit(1))).scalar()
    turns = table(spark, sf, "conversations").select(
        (F.lit(1000000) * F.col("turn") + F.col("conv_id")).alias("query_id"),
        ((F.col("conv_id") + F.col("turn") * 7919) % many).alias("_d"),
    )
    asked = turns.join(documents, "_d").join(vectors, "_d").drop("_d").withColumn("top_k", F.lit(5))
    postings, items = _postings(spark, sf), _vectors(spark, sf)

    def run(distinct):
        return Matches(retrieve(distinct, postings, items).drop("job_family"), distinct)

    return match_distinct(asked, run)


def _unit_length(vector):
    """True for unit length, false for the zero vector of a text without tokens."""
    return F.round(dot(vector, vector), 3) == 1.0


@query("encode_documents", f"SELECT doc_id, 256 AS width, len({sql_tokens('text')}) > 0 AS unit_length FROM documents")
def encode_documents(spark, sf):
    """Hashing encoder over all documents; the texts that have a vector already are not encoded again."""
    documents = texts(spark, sf, "documents").select("doc_id", "text")
    _, known = encode_incremental(texts(spark, sf, "benchmark").select("text"), "text", None, hashing_encoder(), HASHING_MODEL)
    encoded, _ = encode_incremental(documents, "text", known, hashing_encoder(), HASHING_MODEL)
    return encoded.select("doc_id", F.size("embedding").alias("width"), _unit_length("embedding").alias("unit_length"))


def _all_postings(spark, sf):
    """Every document as a posting, with or without a given vector."""
    return texts(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.concat_ws(" ", "lang", "source").alias("job_title"),
        F.col("text").alias("description"), F.lit("").alias("skills"), "text",
        F.upper("source").alias("job_category"), F.upper("lang").alias("job_family"),
    )


@query(
    "build_vectors",
    f"""WITH t AS (SELECT doc_id, concat_ws(' ', concat_ws(' ', lang, source), text) AS body FROM documents)
SELECT doc_id AS item_id, 256 AS width, len({sql_tokens('body')}) > 0 AS unit_length FROM t""",
)
def build_posting_vectors(spark, sf):
    vectors, _ = build_vectors(_all_postings(spark, sf))
    return vectors.select("item_id", F.size("vec").alias("width"), _unit_length("vec").alias("unit_length"))


@query("match_encoded")
def match_encoded(spark, sf):
    """The whole path from text: encode benchmark texts and all postings, retrieve, rerank, explain."""
    postings = _all_postings(spark, sf)
    vectors = checkpointed(build_vectors(postings, check=False)[0])
    requests = texts(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return match(requests, postings, vectors, build_idf(postings), lexicon=LEXICON).results.drop("explanation")


# Comparison and evaluation -----------------------------------------------------------------------

_SQL_TWO_RUNS = f"""{_SQL_PAIRS},
a AS (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM pairs),
b AS (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM pairs
  WHERE v_label <> (q_label + 1) % 10)"""


def _two_runs(spark, sf):
    """``a``: the ten best items of each query; ``b``: the ten best of those without the label after the query's."""
    hits = checkpointed(knn_exact(_queries(spark, sf), _vectors(spark, sf), 30))
    e = table(spark, sf, "embeddings")
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), ((F.col("label") + 1) % 10).alias("unlike"))
    offered = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")
    a = hits.filter("retrieval_rank <= 10")
    b = knn_exact_unlike(asked, offered, 10, hits, 30)
    return tuple(run.withColumnsRenamed({"item_id": "job_id", "retrieval_rank": "rank"}) for run in (a, b))


@query(
    "compare_runs",
    f"""WITH {_SQL_TWO_RUNS} SELECT query_id, item_id AS job_id, a.rank AS rank_a, b.rank AS rank_b,
  a.rank - b.rank AS movement FROM a JOIN b USING (query_id, item_id) WHERE a.rank <= 10 AND b.rank <= 10""",
)
def compare_two_runs(spark, sf):
    return rank_movement(*_two_runs(spark, sf), ["query_id"])


@query(
    "compare_skills",
    f"""WITH {_SQL_TWO_RUNS}, k AS (SELECT doc_id AS item_id, {sql_skills('text')} AS skills FROM documents),
sa AS (SELECT DISTINCT query_id, unnest(skills) AS skill FROM a JOIN k USING (item_id) WHERE rank <= 10),
sb AS (SELECT DISTINCT query_id, unnest(skills) AS skill FROM b JOIN k USING (item_id) WHERE rank <= 10)
SELECT query_id, skill, 'A' AS side FROM (SELECT * FROM sa EXCEPT SELECT * FROM sb)
UNION ALL SELECT query_id, skill, 'B' FROM (SELECT * FROM sb EXCEPT SELECT * FROM sa)""",
)
def compare_skills(spark, sf):
    skills = texts(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), extract_skills("text", LEXICON).alias("matched_skills"))
    a, b = (run.join(skills, "job_id") for run in _two_runs(spark, sf))
    return skill_difference(a, b, ["query_id"])


@query(
    "skill_set",
    f"""SELECT lang, source, string_agg(skill, '|' ORDER BY skill) AS skills FROM
(SELECT DISTINCT lang, source, unnest({sql_skills('text')}) AS skill FROM documents) GROUP BY lang, source""",
)
def skill_sets(spark, sf):
    found = texts(spark, sf, "documents").select("lang", "source", extract_skills("text", LEXICON).alias("matched_skills"))
    distinct = skill_set(found, ["lang", "source"])
    return distinct.groupBy("lang", "source").agg(join_text(F.array_sort(F.collect_set("skill"))).alias("skills"))


def _sql_ndcg(source: str, score: str, k: int = 10) -> str:
    """NDCG@k of ``source(query_id, <score>, rel)`` with tied scores sharing their gain."""
    return f"""g AS (SELECT query_id, avg(rel) OVER (PARTITION BY query_id, {score}) AS gain, rel,
    row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC) AS pos,
    row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS best, count(*) OVER (PARTITION BY query_id) AS size FROM {source}),
n AS (SELECT query_id, max(size) AS size, coalesce(sum(CASE WHEN pos <= {k} THEN gain / log2(pos + 1) END), 0) AS dcg,
    coalesce(sum(CASE WHEN best <= {k} THEN rel / log2(best + 1) END), 0) AS ideal FROM g GROUP BY query_id),
per_query AS (SELECT query_id, round(CASE WHEN size < 2 THEN NULL WHEN ideal = 0 THEN 0.0 ELSE dcg / ideal END, 6) AS ndcg FROM n)"""


def _labelled(spark, sf, results):
    """Relevance of retrieved pairs: equal labels of two different vectors."""
    e = table(spark, sf, "embeddings")
    query, job = (e.select(F.col("vec_id").alias(i), F.col("label").alias(n)) for i, n in (("query_id", "_q"), ("job_id", "_j")))
    relevant = (F.col("_q") == F.col("_j")) & (F.col("query_id") != F.col("job_id"))
    return results.join(query, "query_id").join(job, "job_id").withColumn("relevance", relevant.cast("int")).drop("_q", "_j")


@query(
    "ndcg_baseline",
    f"""WITH {_SQL_RANKED}, r AS (SELECT query_id, score, (q_label = v_label AND query_id <> item_id)::INT::DOUBLE AS rel
  FROM ranked WHERE retrieval_rank <= 10), {_sql_ndcg('r', 'score')} SELECT query_id, ndcg FROM per_query""",
)
def ndcg_baseline(spark, sf):
    hits = knn_exact(_queries(spark, sf), _vectors(spark, sf), 10).withColumnRenamed("item_id", "job_id")
    return ndcg(_labelled(spark, sf, hits)).select("query_id", r6("ndcg").alias("ndcg"))


@query(
    "ndcg_reranked",
    f"""WITH {_SQL_MATCH}, r AS (SELECT query_id, cross_score AS score, (q_label = v_label AND query_id <> item_id)::INT::DOUBLE AS rel
  FROM shown), {_sql_ndcg('r', 'score')} SELECT query_id, ndcg FROM per_query""",
)
def ndcg_reranked(spark, sf):
    results = _match(spark, sf).results.withColumn("score", F.col("cross_encoder_score"))
    return ndcg(_labelled(spark, sf, results)).select("query_id", r6("ndcg").alias("ndcg"))


@query(
    "compare_systems",
    f"""WITH {_SQL_MATCH},
ra AS (SELECT query_id, score, (q_label = v_label AND query_id <> item_id)::INT::DOUBLE AS rel FROM ranked WHERE retrieval_rank <= 10),
rb AS (SELECT query_id, cross_score AS score, (q_label = v_label AND query_id <> item_id)::INT::DOUBLE AS rel FROM shown),
pool AS (SELECT query_id FROM ra WHERE rel > 0 UNION SELECT query_id FROM rb WHERE rel > 0),
a AS (WITH {_sql_ndcg('ra', 'score')} SELECT * FROM per_query JOIN pool USING (query_id)),
b AS (WITH {_sql_ndcg('rb', 'score')} SELECT * FROM per_query JOIN pool USING (query_id))
SELECT 'retrieval' AS system, count(ndcg) AS queries, round(avg(ndcg), 4) AS mean_ndcg FROM a
UNION ALL SELECT 'reranked', count(ndcg), round(avg(ndcg), 4) FROM b""",
)
def compare_both_systems(spark, sf):
    """The truth is pooled: every pair either system returned, labelled once."""
    found = knn_exact(_queries(spark, sf), _vectors(spark, sf), 10)
    hits = checkpointed(found.select("query_id", F.col("item_id").alias("job_id"), F.col("score").alias("bi_encoder_score")))
    reranked = checkpointed(_match(spark, sf).results.select("query_id", "job_id", "cross_encoder_score"))
    pool = hits.select("query_id", "job_id").union(reranked.select("query_id", "job_id")).distinct()
    systems = compare_systems(hits, reranked, _labelled(spark, sf, pool))
    return systems.select("system", "queries", F.round("mean_ndcg", 4).alias("mean_ndcg"))


@query(
    "truth_lookup",
    """WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS job_id, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
t AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS job_id, 1 AS relevance FROM lineitem WHERE l_returnflag = 'R')
SELECT r.query_id, r.job_id, coalesce(t.relevance, 0) AS relevance FROM r LEFT JOIN t USING (query_id, job_id)""",
)
def truth_lookup(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("job_id"), "l_returnflag"
    )
    truth = items.filter("l_returnflag = 'R'").select("query_id", "job_id").distinct().withColumn("relevance", F.lit(1))
    return attach_truth(items.select("query_id", "job_id").distinct(), truth)


@query(
    "mean_ndcg",
    f"""WITH r AS (SELECT o_custkey AS query_id, o_totalprice AS score, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rel FROM orders),
{_sql_ndcg('r', 'score')}, t AS (SELECT DISTINCT query_id FROM r WHERE rel > 0)
SELECT count(ndcg) AS queries, round(avg(ndcg), 4) AS mean_ndcg FROM per_query JOIN t USING (query_id)""",
)
def mean_ndcg_orders(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_totalprice").alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("relevance"),
    )
    return mean_ndcg(ndcg(rows), rows).select("queries", F.round("mean_ndcg", 4).alias("mean_ndcg"))


@query(
    "ndcg_ties",
    f"""WITH r AS (SELECT o_custkey AS query_id, o_orderpriority AS score, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rel FROM orders),
{_sql_ndcg('r', 'score')} SELECT query_id, ndcg FROM per_query""",
)
def ndcg_ties(spark, sf):
    """Five score levels per customer, so nearly every score is tied."""
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("relevance"),
    )
    return ndcg(rows).select("query_id", r6("ndcg").alias("ndcg"))
