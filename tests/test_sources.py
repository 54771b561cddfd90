import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from matchloom.operators.idf import build_idf
from matchloom.plans.corpus import build_vectors, build_weights, clean_postings, demo_corpus, prepare_corpus
from matchloom.sources.csv import POSTING_ALIASES, read_aliased_csv, resolve_columns
from matchloom.sources.export import MARKDOWN_HEADER, markdown_rows, write_json, write_markdown
from matchloom.sources.files import docx_text, extract_docx, extract_text, guard_extracted, read_files
from matchloom.sources.history import read_import, read_request_log
from matchloom.sources.tables import append_vectors, read_corpus, read_idf, read_vectors, write_corpus, write_idf

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, cells=()):
    def p(text):
        return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"

    table = f"<w:tbl><w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in cells)}</w:tr></w:tbl>" if cells else ""
    body = table + "".join(p(t) for t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_resolve_columns():
    assert resolve_columns(["ID", "Position", "Title", "SUMMARY"], POSTING_ALIASES) == {"job_id": 0, "title": 2, "description": 3}
    assert resolve_columns(["id", "ID", "title"], POSTING_ALIASES)["job_id"] == 1
    assert resolve_columns(["x"], POSTING_ALIASES) == {}


def test_aliased_csv(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text('JobID,unused,Title,job_summary,skills\n1,x,"Nurse, senior","line one\nline ""two""",NA\n2,y,Chef,,cooking\n')
    df = read_aliased_csv(spark, str(path), POSTING_ALIASES)
    assert df.columns == ["job_id", "title", "description", "skills"]
    assert rows(df) == [("1", "Nurse, senior", 'line one\nline "two"', None), ("2", "Chef", None, "cooking")]
    with pytest.raises(ValueError):
        read_aliased_csv(spark, str(path), {"a": ("nope",)})


def test_prepare_corpus(spark, tmp_path):
    titles = ["Registered Nurse", "Sales Manager", "Head Chef", "Welder"]
    lines = ["title,description"] + [f"{titles[i % 4]},text {i % 10}" for i in range(40)] + ["  ,--"]
    (tmp_path / "jobs.csv").write_text("\n".join(lines))
    cats = ["Healthcare", "Sales", "Chef"]
    lines = ["ID,Category,Resume_str"] + [f"{i},{cats[i % 3]},resume {i}" for i in range(15)] + ["99,,lost", "0,Healthcare,resume 0"]
    (tmp_path / "resumes.csv").write_text("\n".join(lines))
    out = prepare_corpus(spark, str(tmp_path / "jobs.csv"), str(tmp_path / "resumes.csv"), str(tmp_path / "out"))
    assert out["postings"].count() == 40 and out["resumes"].count() == 15
    first = out["postings"].filter("job_id = 1").first()
    assert (first.text, first.job_category, first.job_family) == ("registered nurse text 0", "REGISTERED-NURSE", "HEALTHCARE")
    pairs = out["pairs"]
    assert pairs.columns == ["resume_id", "resume_category", "resume_text", "job_id", "job_title", "job_text", "relevance"]
    assert pairs.groupBy("resume_id").count().filter("count <> 4").count() == 0 and pairs.count() == 60
    assert out["train"].count() + out["eval"].count() == 60
    assert out["eval"].select("resume_id").distinct().count() == 3


def test_duplicates_keep_the_first(spark):
    raw = spark.createDataFrame([("7", "Nurse", "A b"), ("7", "nurse", "a B!"), ("8", "Nurse", "a b")], "job_id string, title string, description string").coalesce(1)
    kept = clean_postings(raw)
    assert sorted((r.job_id, r.job_title, r.description) for r in kept.collect()) == [(7, "Nurse", "A b"), (8, "Nurse", "a b")]
    with pytest.raises(ValueError):
        clean_postings(raw.drop("title"))


def test_demo_corpus_rebuilds_text(spark):
    jobs = spark.createDataFrame([(i, "Nurse", "word " * 50, "icu") for i in range(30)], "job_id long, job_title string, description string, skills string")
    demo = demo_corpus(jobs, target=10, floor=5, max_chars=9)
    row = demo.first()
    assert demo.count() == 10 and row.description == "word word" and row.text == "nurse word word icu"
    with pytest.raises(ValueError):
        demo_corpus(jobs.withColumn("job_id", F.lit(1)), 10, 5)


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "SALES"), (2, "OTHER")], "job_id long, job_family string")
    write_corpus(df, str(tmp_path / "c"), "job_family")
    plan = read_corpus(spark, str(tmp_path / "c")).filter("job_family = 'SALES'")
    assert rows(plan) == [(1, "SALES")] and "PartitionFilters: [isnotnull" in plan._jdf.queryExecution().toString()
    wide = spark.range(20000).repartition(16).select(F.when(F.col("id") % 3 > 0, "BIG").otherwise(F.concat(F.lit("F"), F.col("id") % 7)).alias("f"), "id")
    write_corpus(wide, str(tmp_path / "r"), "f")
    files = [f.name for f in (tmp_path / "r").rglob("*.parquet")]
    assert len(files) == 8 and read_corpus(spark, str(tmp_path / "r")).count() == 20000  # one per family, not 16 x 8
    texts = spark.createDataFrame([("alpha beta",), ("alpha",), ("",)], "text string")
    write_idf(build_idf(texts), str(tmp_path / "idf"))
    assert [(r.term, r.df) for r in read_idf(spark, str(tmp_path / "idf")).orderBy("term").collect()] == [("alpha", 2), ("beta", 1)]
    assert build_weights(texts, str(tmp_path / "w")).count() == 2
    postings = spark.createDataFrame([(1, "Nurse", "nurse icu")], "job_id long, job_title string, text string")
    vectors, fresh = build_vectors(postings)
    append_vectors(fresh, str(tmp_path / "v"))
    again, none = build_vectors(postings, cache=read_vectors(spark, str(tmp_path / "v")))
    assert none.count() == 0 and rows(again) == rows(vectors)
    with pytest.raises(ValueError):
        build_vectors(postings.drop("text"))


def test_files(spark, tmp_path):
    long_text = "Experienced nurse with many years of patient care in the ICU"
    (tmp_path / "a.docx").write_bytes(docx([long_text], ["Python", "", "SQL"]))
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1.7 rest")
    (tmp_path / "c.docx").write_bytes(b"%PDF not a zip")
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "e.docx").write_bytes(docx(["short"]))
    (tmp_path / "f.txt").write_bytes(b"x" * 2000)
    files = read_files(spark, str(tmp_path), max_bytes=1500)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    assert dict(rows(files.select(name, "kind"))) == {
        "a.docx": "docx", "b.PDF": "pdf", "c.docx": "unsupported", "d.docx": "docx", "e.docx": "docx", "f.txt": "too_large"
    }
    texts = extract_text(files, {"pdf": lambda b: b.decode() + " " + long_text})
    guarded = guard_extracted(texts, status="status").select(name, "status", "text", "char_count", "truncated")
    got = {r.name: r for r in guarded.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "a.docx": "ok", "b.PDF": "ok", "c.docx": "unsupported", "d.docx": "unreadable", "e.docx": "empty", "f.txt": "too_large"
    }
    assert got["a.docx"].text == long_text + " Python SQL" and got["a.docx"].truncated is False
    assert extract_text(files).filter("kind = 'pdf'").first().status == "no_extractor"
    assert extract_docx(files.filter(F.col("path").endswith("e.docx"))).first().raw_text == "short"
    assert docx_text(docx(["p1", "p2"], ["c1"])) == "p1\np2\nc1"


def test_docx_merged_cells():
    def cell(text, props=""):
        return f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"

    wide, start, more = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    body = f"<w:tbl><w:tr>{cell('a', wide)}{cell('b', start)}</w:tr><w:tr>{cell('c')}{cell('d')}{cell('', more)}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
    assert docx_text(out.getvalue()).split("\n") == ["a", "a", "b", "c", "d", "b"]


def test_guard_truncates(spark):
    df = spark.createDataFrame([("word " * 30,), ("x",), (None,)], "raw_text string")
    got = guard_extracted(df, max_chars=60).collect()
    assert [(r.status, r.char_count, r.truncated) for r in got] == [("ok", 60, True), ("empty", None, None), ("empty", None, None)]


def test_history_import(spark, tmp_path):
    result = {"job_id": 1, "job_title": "Nurse", "rank": 1, "explanation": None, "scores": {"bi_encoder": 0.5}}
    entry = {"created_at": 1700000000123, "label": "a", "resume_text": "t", "top_k": 30, "top_n": 10,
             "filters": {"job_families": ["HR"], "min_score": None}, "results": [result]}
    (tmp_path / "one.json").write_text(json.dumps({"entries": [entry, {**entry, "label": "b"}]}))
    got = read_import(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.label) for r in got] == [(0, "a"), (1, "b")]
    assert got[0].created_at == datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert got[0].results[0].job_title == "Nurse" and got[0].filters.job_families == ["HR"]


def test_request_log(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"request_id": "a", "method": "GET", "path": "/x", "status": 200, "took_ms": 1.5}\nnot json\n')
    got = read_request_log(spark, str(tmp_path)).collect()
    assert sorted((r.request_id or "", r._corrupt_record) for r in got) == [("", "not json"), ("a", None)]
    assert read_request_log(spark, str(tmp_path), stream=True).isStreaming


def test_export(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 1, "Registered Nurse", "HEALTHCARE", 0.734, 0.812), (1, 2, "a|b\nc", "INFORMATION-TECHNOLOGY", 1.0, 0.0)],
        "query_id int, rank int, job_title string, job_family string, cross_encoder_probability double, bi_encoder double",
    )
    lines = markdown_rows(df)
    assert [r.line for r in lines.orderBy("rank").collect()] == [
        "| 1 | Registered Nurse | Healthcare | 73.4% | 81.2% |",
        "| 2 | a\\|b c | Information Technology | 100.0% | 0.0% |",
    ]
    write_markdown(lines, str(tmp_path / "md"))
    want = ["<!-- 1 -->", *MARKDOWN_HEADER, *[r.line for r in lines.orderBy("rank").collect()], ""]
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).select("value").collect()] == want
    write_json(df, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2
