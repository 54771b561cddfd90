"""The operators over whole driver tables, with the SQL that must give the same rows where it can."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.llm.common import crc_bucket
from matchloom.llm.exact_dedup import exact_dedup
from matchloom.llm.html_text import extract_text
from matchloom.llm.knn_join import top_k
from matchloom.llm.language_id import fit as fit_language, predict_language
from matchloom.llm.license_scan import license_scan
from matchloom.llm.minhash_dedup import near_dedup
from matchloom.llm.mixing import mix
from matchloom.llm.negatives import hard_negatives, whole_vectors
from matchloom.llm.packing import pack_documents
from matchloom.llm.phrases import collocations
from matchloom.llm.pii import find_personal_data, fit as fit_personal_data
from matchloom.llm.quality import fit as fit_quality, sample_of, score as score_quality
from matchloom.llm.token_store import read_token_store, write_token_store
from matchloom.llm.tokens import tokenizer_path
from matchloom.sources.tables import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op4_exact_dedup",
    r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s
    FROM documents
), r AS (
    SELECT doc_id, s, first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER w = 1 AS kept
    FROM n WINDOW w AS (PARTITION BY s ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(s) AS text_sha256 FROM r
""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op5_minhash_dedup",
    r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
    FROM w WHERE len(w) > 0
), n AS (
    SELECT w.doc_id, coalesce(len(s.s), 0) AS n FROM w LEFT JOIN s USING (doc_id)
), e AS (
    SELECT doc_id, unnest(s) AS shingle FROM s
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), both_ways AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM n
    UNION
    SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT doc_id, n::BIGINT AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept
FROM n JOIN reach ON reach.a = doc_id GROUP BY doc_id, n
""",
)
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), percent=85, shingle=5)


@query("op2_token_store")
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = posixpath.join(shared_folder(spark, "matchloom-llm"), f"tokens-{uuid.uuid4().hex}")
    write_token_store(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"))
    return read_token_store(spark, path)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), capacity=2048)


@query(
    "op7_mixing",
    r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('7-' || doc_id) AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1 ELSE 2 END AS w,
           2.0::DOUBLE * sum(size) AS cap
    FROM d GROUP BY source
), o AS (
    SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place,
           (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / ((SELECT sum(w) FROM s)
             - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
    FROM s
), t AS (
    SELECT source, source_size,
           least((SELECT arg_min(lev, place) FROM o WHERE lev * w < cap) * w, cap) AS target
    FROM o
), b AS (
    SELECT greatest(1, least(4096, floor(sum(target) / 65536)))::BIGINT AS words, sum(target) AS total FROM t
), iv AS (
    SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low,
           ceil(source_size / (SELECT words FROM b))::BIGINT AS blocks
    FROM (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / (SELECT total FROM b) AS high
          FROM t WHERE target > 0)
), slot AS (
    SELECT i, list_sum(list_transform(range(32), lambda k: ((i >> k) & 1) << (31 - k)))::DOUBLE / 4294967296.0::DOUBLE AS u
    FROM (SELECT unnest(range(ceil((SELECT total / words FROM b))::BIGINT)) AS i)
), ranked AS (
    SELECT iv.source, iv.blocks, row_number() OVER (PARTITION BY iv.source ORDER BY slot.i) - 1 AS r
    FROM slot JOIN iv ON slot.u >= iv.low AND (slot.u < iv.high OR iv.high >= 1)
), times AS (
    SELECT source, r % blocks AS block, count(*) AS n FROM ranked WHERE r < 2 * blocks GROUP BY ALL
), line AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM d
), parts AS (
    SELECT doc_id, source, size, pos, unnest(range(pos // (SELECT words FROM b), (pos + size - 1) // (SELECT words FROM b) + 1)) AS block
    FROM line WHERE size > 0
), taken AS (
    SELECT p.doc_id, sum((least(pos + size, (block + 1) * words) - greatest(pos, block * words)) * n) AS taken
    FROM parts p JOIN times USING (source, block), b GROUP BY ALL
)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (doc_id)
""",
)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(documents(spark, sf_dir), share=1.5, most=2.0, weights=(3, 1, 2))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op8_knn_join",
    """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def op8_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    docs = documents(spark, sf_dir)
    model = fit_language(docs.filter(crc_bucket("doc_id", 4) != 2).select("text", "lang"))
    found = predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUALITY_METADATA = ("n_chars",)
QUALITY_THRESHOLD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame):
    """Learned from labelled rows outside the held-out fifth of ids."""
    labels = sample_of(labels.filter(crc_bucket("doc_id", 5) != 0), "quality")
    labelled = docs.select("doc_id", "text", *QUALITY_METADATA).join(labels, "doc_id")
    return fit_quality(labelled, "quality", QUALITY_METADATA)


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    scored = score_quality(docs.select("doc_id", "text", *QUALITY_METADATA, held_out.alias("held_out")), model, QUALITY_METADATA)
    predicted = F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", "held_out", "score", predicted.alias("predicted"))


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


@query(
    "op11_collocations",
    r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS gram
    FROM w, (SELECT unnest([1, 2, 3]) AS size)
), f AS (
    SELECT lang, size, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 10
), words AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), c AS (
    SELECT lang, size, gram, n AS a, string_split(gram, ' ') AS w FROM f WHERE size > 1
), parts AS (
    SELECT *, unnest(range(1, size)) AS k FROM c
), cuts AS (
    SELECT p.lang, p.gram, p.a, p.k, x.n AS l, y.n AS r,
           ((1000000::HUGEINT * p.a * p.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM parts p
    JOIN f x ON x.lang = p.lang AND x.gram = array_to_string(p.w[1 : p.k], ' ')
    JOIN f y ON y.lang = p.lang AND y.gram = array_to_string(p.w[p.k + 1 : p.size], ' ')
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), inside AS (
    SELECT lang, gram, max(a) AS within FROM (
        SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS gram FROM c WHERE size = 3
    ) GROUP BY ALL
), ranked AS (
    SELECT weakest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank
    FROM weakest LEFT JOIN inside USING (lang, gram) WHERE within IS NULL OR 100 * within < 50 * a
)
SELECT lang, rank, gram AS phrase, a, l, r, words.n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"), longest=3, least=10, covered=50, first=2000)


@query(
    "op12_hard_negatives",
    """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), p AS (
    SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), every=100, positives=5, negatives=10, low=30, high=90)


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find_personal_data(docs, fit_personal_data(docs))
