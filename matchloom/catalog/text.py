"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.catalog.registry import (
    LEXICON, join_text, query, r6, sql_digest, sql_explain_normalize, sql_normalize, sql_skills, sql_squeeze,
    sql_strip, sql_tokens, table, texts,
)
from matchloom.functions.keys import category_key, email_key, filters_digest, request_key, text_digest, text_hash
from matchloom.functions.scores import scale_scores, sigmoid, to_percent
from matchloom.functions.skills import extract_skills, skill_domains
from matchloom.functions.taxonomy import derive_family, label_relevance
from matchloom.functions.text import (
    cap, clean_text, combine_text, derive_label, embedding_text, explain_normalize, family_label, first_non_empty,
    first_non_null, highlight_parts, normalize_text, squeeze, token_counts,
)
from matchloom.operators.idf import build_idf
from matchloom.operators.lists import duplicate_emails
from matchloom.operators.metrics import family_facet
from matchloom.operators.phrase_match import find_skills
from matchloom.sources.files import guard_extracted

# Test taxonomies for ``part``; declaration order decides ("red ring" is a RING).
PART_FAMILIES = {"RING": ("ring",), "BOLT-ROD": ("bolt", "rod"), "COLOUR": ("red", "blue"), "SIZE": ("large", "small")}
PART_SQL_FAMILY = """CASE WHEN regexp_matches(n, '(^| )(ring)( |$)') THEN 'RING'
        WHEN regexp_matches(n, '(^| )(bolt|rod)( |$)') THEN 'BOLT-ROD'
        WHEN regexp_matches(n, '(^| )(red|blue)( |$)') THEN 'COLOUR'
        WHEN regexp_matches(n, '(^| )(large|small)( |$)') THEN 'SIZE' ELSE 'OTHER' END"""
PART_SQL_NAMES = f"SELECT *, {sql_normalize('p_name')} AS n FROM part"
PART_SQL_LABEL = """CASE family WHEN 'RING' THEN 'Ring' WHEN 'BOLT-ROD' THEN 'Bolt Rod' WHEN 'COLOUR' THEN 'Colour'
        WHEN 'SIZE' THEN 'Size' ELSE 'Other' END"""


@query("normalize_pages", f"SELECT page_id, {sql_normalize('html')} AS norm FROM pages")
def normalize_pages(spark, sf):
    return texts(spark, sf, "pages").select("page_id", normalize_text("html", unicode=False).alias("norm"))


@query(
    "normalize_documents",
    f"""SELECT doc_id, upper(replace({sql_normalize('source')}, ' ', '-')) AS source_key,
       trim(regexp_replace(concat_ws(' ', {sql_normalize('source')}, {sql_normalize('text')}, {sql_normalize('lang')}), ' +', ' ', 'g')) AS combined
FROM documents""",
)
def normalize_documents(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id",
        category_key("source", unicode=False).alias("source_key"),
        combine_text("source", "text", "lang", unicode=False).alias("combined"),
    )


# the driver's texts are in NFKC already, so that the fold must change nothing; unit tests have the others
@query("normalize_documents_unicode", f"SELECT doc_id, {sql_normalize('text')} AS norm FROM documents")
def normalize_documents_unicode(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", normalize_text("text").alias("norm"))


@query("strip_documents", f"SELECT doc_id, {sql_strip('text')} AS text, '' AS note FROM documents")
def strip_documents(spark, sf):
    documents = texts(spark, sf, "documents").select("doc_id", "text")
    return clean_text(clean_text(documents, "text"), "note")


@query(
    "text_digest",
    f"SELECT conv_id, turn, {sql_squeeze('text')} AS squeezed, {sql_digest('text')} AS digest FROM conversations",
)
def text_digests(spark, sf):
    return texts(spark, sf, "conversations").select(
        "conv_id", "turn", squeeze("text").alias("squeezed"), text_digest("text").alias("digest")
    )


_FILTER_JSON = """concat('{"job_families": ', coalesce('[' || array_to_string(list_transform(fams, lambda f: '"' || f || '"'), ', ') || ']', 'null'),
  ', "min_score": ', coalesce(CASE ms WHEN 0.5 THEN '0.5' WHEN 0.25 THEN '0.25' WHEN 1.0 THEN '1.0' WHEN 0.0001 THEN '0.0001' END, 'null'), '}')"""


@query(
    "request_key",
    f"""WITH r AS (
  SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN [lang] WHEN 1 THEN [lang, source] END AS fams,
    CASE doc_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0001 END AS ms,
    1 + doc_id % 40 AS top_k, 1 + doc_id % 20 AS top_n FROM documents),
d AS (SELECT *, substring(sha256(CASE WHEN doc_id % 7 = 6 THEN '{{}}' ELSE {_FILTER_JSON} END), 1, 8) AS filters_digest FROM r)
SELECT doc_id, filters_digest, concat('match:v1:', {sql_digest('text')}, ':', top_k, ':', top_n, ':', filters_digest, ':', doc_id % 2) AS key FROM d""",
)
def request_keys(spark, sf):
    d = texts(spark, sf, "documents")
    families = F.when(d.doc_id % 3 == 0, F.array("lang")).when(d.doc_id % 3 == 1, F.array("lang", "source"))
    scores = (
        F.when(d.doc_id % 5 == 0, 0.5).when(d.doc_id % 5 == 1, 0.25).when(d.doc_id % 5 == 2, 1.0).when(d.doc_id % 5 == 3, 0.0001)
    )
    digest = d.select("doc_id", "text", filters_digest(families, scores, d.doc_id % 7 != 6).alias("filters_digest"))
    return digest.select(
        "doc_id",
        "filters_digest",
        request_key(
            text_digest("text"), 1 + F.col("doc_id") % 40, 1 + F.col("doc_id") % 20, F.col("filters_digest"),
            F.col("doc_id") % 2,
        ).alias("key"),
    )


@query(
    "vector_keys",
    f"SELECT doc_id, sha256(concat('hashing-tf', chr(0), {sql_squeeze('text')})) AS text_hash FROM documents",
)
def vector_keys(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", text_hash("text", "hashing-tf").alias("text_hash"))


@query("explain_normalize", f"SELECT doc_id, {sql_explain_normalize('text')} AS norm FROM documents")
def explain_normalized(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", explain_normalize("text").alias("norm"))


@query(
    "token_counts",
    f"""SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest({sql_tokens('text')}) AS term FROM documents)
GROUP BY lang, term""",
)
def token_counts_by_lang(spark, sf):
    return token_counts(texts(spark, sf, "documents"), "text", ["lang"])


@query(
    "idf_top",
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct({sql_tokens('substring(text, 1, 1200)')})) AS term FROM documents),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term ORDER BY df DESC, term LIMIT 50000)
SELECT term, df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0, 6) AS idf FROM f""",
)
def idf_top(spark, sf):
    return build_idf(texts(spark, sf, "documents")).select("term", "df", r6("idf").alias("idf"))


@query(
    "derive_family_parts",
    f"""WITH n AS ({PART_SQL_NAMES}), f AS (SELECT p_partkey, {PART_SQL_FAMILY} AS family FROM n)
SELECT p_partkey, family, {PART_SQL_LABEL} AS label FROM f""",
)
def derive_family_parts(spark, sf):
    family = derive_family("p_name", PART_FAMILIES, unicode=False)
    return table(spark, sf, "part").select("p_partkey", family.alias("family")).withColumn("label", family_label("family"))


@query(
    "family_facet",
    f"""WITH n AS ({PART_SQL_NAMES}), f AS (SELECT {PART_SQL_FAMILY} AS family FROM n)
SELECT family, {PART_SQL_LABEL} AS label, count(*) AS n FROM f GROUP BY family""",
)
def family_facets(spark, sf):
    part = table(spark, sf, "part")
    return family_facet(part.select(derive_family("p_name", PART_FAMILIES, unicode=False).alias("job_family")))


@query(
    "label_relevance",
    f"""WITH n AS ({PART_SQL_NAMES})
SELECT p_partkey, p_type, CAST(CASE p_type WHEN 'PROMO' THEN regexp_matches(n, '(^| )(ring|gear)( |$)')
  WHEN 'ECONOMY' THEN regexp_matches(n, '(^| )(hot widget|cold widget|rod)( |$)')
  ELSE contains(concat(' ', n, ' '), concat(' ', lower(p_type), ' ')) END AS INTEGER) AS relevance FROM n""",
)
def label_relevance_parts(spark, sf):
    taxonomy = {"PROMO": ("ring", "gear"), "ECONOMY": ("hot widget", "cold widget", "rod")}
    return table(spark, sf, "part").select(
        "p_partkey", "p_type", label_relevance("p_type", "p_name", taxonomy, unicode=False).alias("relevance")
    )


@query("skills_documents", f"SELECT doc_id, array_to_string({sql_skills('text')}, '|') AS skills FROM documents")
def skills_documents(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", join_text(extract_skills("text", LEXICON)).alias("skills"))


_SQL_DOMAINS = ", ".join(f"('{s.canonical}', '{s.domain}')" for s in LEXICON)


@query(
    "skill_domains",
    f"""WITH s AS (SELECT lang, unnest({sql_skills('text')}) AS skill FROM documents)
SELECT lang, skill, d.domain AS domains, count(*) AS n FROM s JOIN (VALUES {_SQL_DOMAINS}) d(skill2, domain) ON skill = skill2
GROUP BY lang, skill, d.domain""",
)
def skill_domain_counts(spark, sf):
    found = texts(spark, sf, "documents").select("lang", F.explode(extract_skills("text", LEXICON)).alias("skill"))
    counts = found.groupBy("lang", "skill").agg(F.count(F.lit(1)).alias("n"))
    return skill_domains(counts, LEXICON).select("lang", "skill", join_text("domains").alias("domains"), "n")


@query(
    "truncations",
    f"""WITH s AS (SELECT doc_id, source, text, {sql_squeeze('text')} AS flat FROM documents)
SELECT doc_id, substring(flat, 1, 1200) AS rerank_text, substring(text, 1, 400) AS history_text,
  CASE WHEN length(flat) > 50 THEN rtrim(substring(flat, 1, 50)) || '…' ELSE flat END AS label,
  {sql_squeeze("source || ' ' || text")} AS embedded FROM s""",
)
def truncations(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id",
        cap(squeeze("text"), 1200).alias("rerank_text"),
        cap("text", 400).alias("history_text"),
        derive_label("text").alias("label"),
        embedding_text("source", "text").alias("embedded"),
    )


@query(
    "highlight",
    r"SELECT doc_id, regexp_replace(text, '(?i)(under the|the|and|c\+\+|der)', '[\1]', 'g') AS marked FROM documents",
)
def highlight(spark, sf):
    terms = F.array(*[F.lit(t) for t in (" the", "and ", "", "c++", "der", "under the")])
    parts = highlight_parts("text", terms)
    marked = F.transform(parts, lambda p: F.when(p["is_match"], F.concat(F.lit("["), p["part"], F.lit("]"))).otherwise(p["part"]))
    return texts(spark, sf, "documents").select("doc_id", F.array_join(marked, "").alias("marked"))


@query(
    "scale_scores",
    """WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo,
  max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders)
SELECT o_custkey, o_orderkey, round(CASE WHEN hi = lo THEN 100.0 ELSE (v - lo) / (hi - lo) * 100.0 END, 6) AS scaled FROM w""",
)
def scaled_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return scale_scores(orders, "o_totalprice", "o_custkey").select("o_custkey", "o_orderkey", r6("scaled").alias("scaled"))


@query(
    "sigmoid",
    """SELECT c_custkey, round(1.0 / (1.0 + exp(-c_acctbal / 1000.0)), 6) AS probability,
  round(c_acctbal / 10000.0 * 100.0, 6) AS percent FROM customer""",
)
def sigmoids(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select(
        "c_custkey",
        r6(sigmoid(F.col("c_acctbal") / 1000.0)).alias("probability"),
        r6(to_percent(F.col("c_acctbal") / 10000.0)).alias("percent"),
    )


@query(
    "email_duplicates",
    """SELECT lower(trim(concat(' ', c_mktsegment, c_nationkey, '@Example.COM '))) AS email_key, count(*) AS n
FROM customer GROUP BY 1 HAVING count(*) > 1""",
)
def email_duplicates(spark, sf):
    email = F.concat(F.lit(" "), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("@Example.COM "))
    return duplicate_emails(table(spark, sf, "customer"), email_key(email))


@query(
    "candidate_text",
    """WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source END AS job_text, lang AS text,
  source AS description FROM documents)
SELECT doc_id, coalesce(job_text, text, description) AS rerank_text,
  coalesce(nullif(job_text, ''), nullif(text, ''), nullif(description, ''), '') AS explain_text FROM c""",
)
def candidate_text(spark, sf):
    d = texts(spark, sf, "documents")
    job_text = F.when(d.doc_id % 3 == 1, "").when(d.doc_id % 3 == 2, d.source)
    return d.select("doc_id", job_text.alias("job_text"), "lang", "source").select(
        "doc_id",
        first_non_null("job_text", "lang", "source").alias("rerank_text"),
        first_non_empty("job_text", "lang", "source").alias("explain_text"),
    )


@query(
    "extraction_guard",
    f"""WITH s AS (SELECT doc_id, n_chars, {sql_squeeze('text')} AS flat FROM documents),
o AS (SELECT *, CASE WHEN n_chars > 30000 THEN 'too_large' WHEN length(flat) < 40 THEN 'empty' ELSE 'ok' END AS status FROM s)
SELECT doc_id, status, CASE WHEN status = 'ok' THEN substring(flat, 1, 20000) END AS text,
  CAST(CASE WHEN status = 'ok' THEN least(length(flat), 20000) END AS INTEGER) AS char_count,
  CASE WHEN status = 'ok' THEN length(flat) > 20000 END AS truncated FROM o""",
)
def extraction_guard(spark, sf):
    files = texts(spark, sf, "documents").select("doc_id", "n_chars", F.col("text").alias("raw_text"))
    guarded = guard_extracted(files, length="n_chars", max_bytes=30_000)
    return guarded.select("doc_id", "status", "text", "char_count", "truncated")


def _long_words(spark, sf):
    """A lexicon of tens of thousands of rows: every token of seven or more letters that the documents hold."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9+#]+"), 0)
    words = texts(spark, sf, "documents").select(F.explode(tokens).alias("canonical")).filter("length(canonical) >= 7").distinct()
    return words.select("canonical", F.lit("words").alias("domain"), F.array("canonical").alias("aliases"))


@query(
    "skills_lexicon",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#]+'),
  lambda t: length(t) >= 7))), '|') AS skills FROM documents""",
)
def skills_lexicon(spark, sf):
    found = find_skills(texts(spark, sf, "documents").select("doc_id", "text"), _long_words(spark, sf), "doc_id")
    return found.select("doc_id", join_text("skills").alias("skills"))
