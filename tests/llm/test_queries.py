"""The registered queries over the smallest driver tables."""

import os

import pytest
from compare import compare, duck

import corpus_pipeline
from matchloom.llm.packing import CAPACITY
from matchloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op2_token_store", "op6_packing", "op9_language_id", "op13_personal_data"])
def test_every_document_is_there(spark, name):
    got = QUERIES[name](spark, SF).select("doc_id").distinct().count()
    assert got == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op9_language_id"](spark, SF).join(docs, "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = QUERIES["op1_quality_classifier"](spark, SF).join(labels, "doc_id").filter("held_out")
    assert found.filter("quality = predicted").count() >= 0.9 * found.count()


def test_pages_and_licenses(spark):
    pages = QUERIES["op3_html_text"](spark, SF).collect()
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count() and all("<p>" not in p.text for p in pages)
    assert QUERIES["op10_license_scan"](spark, SF).columns[:2] == ["doc_id", "license"]


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    full = {}
    for r in rows:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert rows and max(full.values()) <= CAPACITY
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, ties and a further column."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    schema = docs.schema
    odd = [
        (None, "a text without an id " * 9, None, None, None), (900_001, None, "en", None, 0), (900_002, "", None, "s", None),
        (900_003, "one and the same text of some length " * 8, "en", "s", 296), (900_003, "one and the same text of some length " * 8, "en", "s", 296),
        (900_004, "one and the same text of some length " * 8, "en", None, 296),
    ]
    order = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = spark.createDataFrame(odd, ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in order))
    now = docs.select(order).unionByName(odd)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        path = f"{tmp_path}/{number}"
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == order
    kept = [r.doc_id for r in now.collect()]
    assert 900_004 not in kept and kept
    packed = corpus_pipeline.STAGES[4][1](spark, odd, SF).collect()
    assert len(packed) == 6 and sum(r.length == 1 for r in packed) == 2
