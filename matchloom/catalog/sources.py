"""Queries that write the given tables in a source's format and read them back through the library."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from matchloom.catalog.registry import query, sql_normalize, sql_squeeze, table, texts
from matchloom.functions.text import STOP_WORDS, squeeze
from matchloom.operators.encoding import HASHING_MODEL, encode_incremental, hashing_encoder
from matchloom.operators.idf import build_idf
from matchloom.plans.corpus import prepare_corpus
from matchloom.sources.csv import read_aliased_csv
from matchloom.sources.export import write_json
from matchloom.sources.files import extract_text, guard_extracted, with_kind
from matchloom.sources.history import read_import, read_request_log
from matchloom.sources.tables import (
    append_vectors, read_corpus, read_idf, read_vectors, shared_folder, write_corpus, write_idf,
)


def _folder(spark, name):
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def _write_csv(df, path):
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


@query(
    "csv_source",
    f"SELECT doc_id::VARCHAR AS job_id, source AS title, {sql_squeeze('text')} AS description FROM documents",
)
def csv_source(spark, sf):
    """Headers in odd case, an unused column, quotes and line breaks inside cells."""
    path = _folder(spark, "csv")
    documents = texts(spark, sf, "documents")
    _write_csv(
        documents.select(F.col("doc_id").alias("JobID"), F.col("n_chars").alias("unused"), F.col("text").alias("Job_Summary"),
                         F.col("source").alias("POSITION")),
        path,
    )
    aliases = {"job_id": ("job_id", "id", "jobid"), "title": ("title", "position"), "description": ("description", "job_summary")}
    return read_aliased_csv(spark, path, aliases).withColumn("description", squeeze("description"))


@query("parquet_corpus", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de'")
def parquet_corpus(spark, sf):
    """Partitioned by language; the filter reads one directory."""
    path = _folder(spark, "corpus")
    write_corpus(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang"), path, "lang")
    return read_corpus(spark, path).filter("lang = 'de'").drop("lang")


@query(
    "idf_asset",
    """WITH t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(substring(text, 1, 1200)), '[a-z0-9][a-z0-9+#./-]+'))) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT CAST(sum(df) AS BIGINT) AS total, count(*) FILTER (WHERE df > 1) AS repeated, round(sum(ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1.0), 4) AS weight FROM f
WHERE term NOT IN ('""" + "', '".join(STOP_WORDS) + "')",
)
def idf_asset(spark, sf):
    path = _folder(spark, "idf")
    write_idf(build_idf(texts(spark, sf, "benchmark")), path)
    return read_idf(spark, path).agg(
        F.sum("df").alias("total"), F.count_if(F.col("df") > 1).alias("repeated"), F.round(F.sum("idf"), 4).alias("weight")
    )


_DOCX = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    "{paragraphs}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>{cell}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
)


@query(
    "docx_files",
    f"""WITH s AS (SELECT doc_id, {sql_squeeze("regexp_replace(text || chr(10) || source, '[' || chr(1) || '-' || chr(8) || chr(11) || chr(12) || chr(14) || '-' || chr(31) || ']', ' ', 'g')")} AS flat FROM documents)
SELECT doc_id, 'docx' AS kind, CASE WHEN length(flat) < 40 THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN length(flat) >= 40 THEN substring(flat, 1, 20000) END AS text FROM s""",
)
def docx_files(spark, sf):
    """Every document as a DOCX file (lines as paragraphs, the source in a table cell), extracted and guarded."""
    printable = F.regexp_replace("text", r"[\x01-\x08\x0B\x0C\x0E-\x1F]", " ")  # not allowed in XML

    def build(frames):
        for frame in frames:
            files = []
            for text, source in zip(frame["text"], frame["source"]):
                lines = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("word/document.xml", _DOCX.format(paragraphs=lines, cell=escape(source)))
                files.append(out.getvalue())
            yield pd.DataFrame({"path": frame["doc_id"].astype(str) + ".docx", "length": [len(f) for f in files], "content": files})

    documents = texts(spark, sf, "documents").select("doc_id", printable.alias("text"), "source")
    files = with_kind(documents.mapInPandas(build, "path string, length long, content binary"))
    guarded = guard_extracted(extract_text(files), length="length", status="status")
    return guarded.select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), "kind", "status", "text")


@query(
    "history_import",
    """SELECT o_custkey AS user_id, o_orderkey AS run, epoch_ms(o_orderdate) AS created_ms, o_orderstatus AS family,
  CAST(o_orderkey % 30 + 1 AS INTEGER) AS top_k FROM orders""",
)
def history_import(spark, sf):
    """One entry per order; a payload holds at most a hundred entries of one customer."""
    path = _folder(spark, "import")
    entry = F.struct(
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.col("o_orderkey").cast("string").alias("label"),
        F.col("o_custkey").cast("string").alias("resume_text"), (F.col("o_orderkey") % 30 + 1).cast("int").alias("top_k"),
        F.lit(10).alias("top_n"), F.struct(F.array("o_orderstatus").alias("job_families")).alias("filters"),
        F.array().cast("array<struct<job_id:bigint>>").alias("results"),
    )
    payloads = table(spark, sf, "orders").groupBy("o_custkey", F.floor(F.col("o_orderkey") / 100)).agg(F.collect_list(entry).alias("entries")).select("entries")
    write_json(payloads, path)
    runs = read_import(spark, path, multi_line=False)
    return runs.select(
        F.col("resume_text").cast("long").alias("user_id"), F.col("label").cast("long").alias("run"),
        F.unix_millis("created_at").alias("created_ms"), F.col("filters.job_families")[0].alias("family"), "top_k",
    )


@query(
    "request_log",
    """SELECT event_type AS path, count(*) AS requests, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, round(sum(value), 4) AS total_ms
FROM events GROUP BY event_type""",
)
def request_log(spark, sf):
    path = _folder(spark, "log")
    events = table(spark, sf, "events")
    write_json(
        events.select(
            F.col("event_id").cast("string").alias("request_id"), F.lit("POST").alias("method"), F.col("event_type").alias("path"),
            F.when(F.col("event_id") % 9 == 0, 503).otherwise(200).alias("status"), F.col("value").alias("took_ms"),
        ),
        path,
    )
    log = read_request_log(spark, path)
    return log.groupBy("path").agg(
        F.count("request_id").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"),
        F.round(F.sum("took_ms"), 4).alias("total_ms"),
    )


@query(
    "vector_store",
    f"""SELECT (SELECT count(DISTINCT {sql_squeeze('text')}) FROM documents) AS stored, (SELECT count(*) FROM documents) AS served,
  0::BIGINT AS encoded_again""",
)
def vector_store(spark, sf):
    """Encode every distinct text once, store, read back: the second pass encodes nothing."""
    path = _folder(spark, "vectors")
    documents = texts(spark, sf, "documents").select("doc_id", "text")
    _, fresh = encode_incremental(documents, "text", None, hashing_encoder(), HASHING_MODEL)
    append_vectors(fresh, path)
    stored = read_vectors(spark, path)
    served, again = encode_incremental(documents, "text", stored, hashing_encoder(), HASHING_MODEL)
    rows = F.count(F.lit(1))
    return stored.agg(rows.alias("stored")).select(
        "stored", served.agg(rows.alias("n")).scalar().alias("served"), again.agg(rows.alias("n")).scalar().alias("encoded_again")
    )


@query(
    "prepare_corpus",
    f"""WITH n AS (SELECT {sql_normalize('p_name')} AS title FROM part),
s AS (SELECT count(*) FILTER (WHERE regexp_matches(title, '(^| )(ring|gear)( |$)')) AS building,
  count(*) FILTER (WHERE regexp_matches(title, '(^| )(rod)( |$)')) AS machinery, count(*) AS jobs FROM n),
r AS (SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS b, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m, count(*) AS resumes FROM customer)
SELECT jobs AS postings, resumes, (b + m) * 4 AS pairs, CAST(ceil(0.2 * (b + m)) AS BIGINT) * 4 AS eval_pairs, 0::BIGINT AS shared_resumes FROM s, r""",
)
def prepare_corpus_csv(spark, sf):
    """CSV to five tables. Each customer with a known segment gets one positive and three negatives."""
    folder = _folder(spark, "prepared")
    _write_csv(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), f"{folder}/jobs")
    _write_csv(
        table(spark, sf, "customer").select(
            F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("Category"), F.col("c_name").alias("Resume_str")
        ),
        f"{folder}/resumes",
    )
    taxonomy = {"BUILDING": ("ring", "gear"), "MACHINERY": ("rod",)}
    out = prepare_corpus(spark, f"{folder}/jobs", f"{folder}/resumes", f"{folder}/out", taxonomy)
    rows = F.count(F.lit(1))
    train = out["train"].select("resume_id").distinct()
    shared = out["eval"].select("resume_id").distinct().join(train, "resume_id")

    def size(df):
        return df.agg(rows.alias("n")).scalar()

    return out["postings"].agg(rows.alias("postings")).select(
        "postings", size(out["resumes"]).alias("resumes"), size(out["pairs"]).alias("pairs"), size(out["eval"]).alias("eval_pairs"),
        size(shared).alias("shared_resumes"),
    )
