import hashlib
import json
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from matchloom.functions.keys import category_key, email_key, filters_digest, json_fraction, json_string, request_key, text_digest
from matchloom.functions.scores import one_decimal, scale_scores, sigmoid
from matchloom.functions.text import (
    STOP_WORDS, clean_text, clip_results, combine_text, derive_label, explain_normalize, family_label,
    first_non_empty, first_non_null, highlight_parts, is_blank, normalize_text, squeeze, strip, tokens,
)

SPACES = "a b c\x1cd\x85e\t\r\n f　\x0b g "


def test_normalize_text(one):
    assert one(normalize_text("t"), t="<b>Senior</b>\tC++ Engineer\r\n(R&D)") == "senior c engineer r d"
    assert one(normalize_text("t"), t="Ｆｕｌｌ ﬁne") == "full fine"
    assert one(normalize_text("t"), t="café Zoë") == "caf zo"
    assert one(normalize_text("t"), t=None) == ""
    assert one(normalize_text("t", unicode=False), t="plain  TEXT.") == "plain text"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_text_functions_match_python(spark, texts):
    import re

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", squeeze("t").alias("s"), normalize_text("t").alias("n"), strip("t").alias("p")).collect()
    for row in got:
        text = texts[row.i]
        assert row.s == " ".join(text.split())
        assert row.p == text.strip()
        folded = re.sub("[^0-9A-Za-z]+", " ", re.sub("<[^>]+>", " ", unicodedata.normalize("NFKC", text)))
        assert row.n == folded.strip().lower()


def test_squeeze_is_python_split(one):
    assert one(squeeze("t"), t=SPACES) == " ".join(SPACES.split())
    assert one(strip("t"), t="  x y ") == "x y"


def test_is_blank(one):
    for text in ("", " \t", "\u00a0\u2003\x1c\x85", None):
        assert one(is_blank("t"), t=text) is True
    assert one(is_blank("t"), t="  é") is False


def test_combine_and_clean(spark, one):
    assert one(combine_text("a", "b", "c"), a="Nurse!", b="--", c="ICU, care") == "nurse icu care"
    df = spark.createDataFrame([(None,), ("  x ",)], "a string")
    assert sorted(r.a for r in clean_text(df, "a").collect()) == ["", "x"]
    assert [r.b for r in clean_text(df, "b").collect()] == ["", ""]


def test_explain_normalize_and_tokens(one):
    assert one(explain_normalize("t"), t="Node.JS / C++") == "node.js / c++"
    assert one(tokens("t"), t="The Python. devs and C++/C# I a, x node.js") == ["python.", "devs", "c++/c#", "node.js"]
    assert one(tokens("t"), t=None) == []
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 85


def test_labels(one):
    assert one(family_label("f"), f="INFORMATION-TECHNOLOGY") == "Information Technology"
    assert one(family_label("f"), f="fooBar__x") == "foobar x"
    long = "word " * 20
    assert one(derive_label("t"), t=long) == (" ".join(long.split())[:50].rstrip() + "…")
    assert one(derive_label("t"), t=" short  text ") == "short text"


def test_coalesce_order(one):
    assert one(first_non_null("a", "b"), a="", b="x") == ""
    assert one(first_non_empty("a", "b"), a="", b="x") == "x"


@pytest.mark.parametrize(
    "families, score",
    [(None, None), (["SALES", "HR"], None), (["HR", "SALES"], 0.5), ([], 1.0), (['a"b', "é\\", "😀\n"], 0.0), (None, 0.0001), (None, 1.25e-05), (None, 0.734)],
)
def test_filters_digest_is_json(one, families, score):
    body = json.dumps({"job_families": families, "min_score": score}, sort_keys=True)
    want = hashlib.sha256(body.encode()).hexdigest()[:8]
    column = F.array(*[F.lit(f) for f in families]).cast("array<string>") if families is not None else F.lit(None).cast("array<string>")
    assert one(filters_digest(column, F.lit(score).cast("double"))) == want


def test_absent_filters_differ(one):
    null = F.lit(None)
    absent = one(filters_digest(null.cast("array<string>"), null.cast("double"), False))
    assert absent == hashlib.sha256(b"{}").hexdigest()[:8]
    assert absent != one(filters_digest(null.cast("array<string>"), null.cast("double"), True))


@pytest.mark.parametrize("x", [0.0, 1.0, 0.5, 0.1, 0.001, 0.0001, 0.000125, 1e-05, 1.25e-10, 0.30000000000000004])
def test_json_fraction(one, x):
    assert one(json_fraction(F.lit(x))) == json.dumps(x)


def test_json_string(one):
    for text in ('plain', 'q"\\', "tab\tnul\x01", "é 😀"):
        assert one(json_string(F.lit(text))) == json.dumps(text)


def test_digests(one):
    digest = hashlib.sha256(b"a b c").hexdigest()[:16]
    assert one(text_digest("t"), t=" a  b\n c ") == digest
    key = request_key(text_digest("t"), F.lit(30), F.lit(10), F.lit("0123abcd"), F.lit(True))
    assert one(key, t="a b c") == f"match:v1:{digest}:30:10:0123abcd:1"
    assert one(category_key("t"), t=" Public relations ") == "PUBLIC-RELATIONS"
    assert one(email_key("t"), t=" Ann@Example.COM ") == "ann@example.com"


@pytest.mark.parametrize(
    "text, terms, want",
    [
        ("Use Python and C++ daily", ["c++", "python"], ["Use ", "Python", " and ", "C++", " daily"]),
        ("java and javascript", ["java", "javascript"], ["", "java", " and ", "javascript", ""]),
        ("nothing here", ["", "  "], ["nothing here"]),
        ("a.b axb", ["a.b"], ["", "a.b", " axb"]),
        ("pythonjava", ["python", "java"], ["", "python", "", "java", ""]),
    ],
)
def test_highlight(one, text, terms, want):
    parts = one(highlight_parts("t", F.array(*[F.lit(t) for t in terms])), t=text)
    assert [p.part for p in parts] == want
    assert [p.is_match for p in parts] == [i % 2 == 1 for i in range(len(want))]


def test_scores(spark, one):
    assert abs(one(sigmoid("x"), x=0.0) - 0.5) < 1e-12
    assert one(sigmoid("x"), x=-1000.0) == 0.0
    assert one(one_decimal(F.lit(73.4))) == "73.4" and one(one_decimal(F.lit(0.25))) == "0.3"
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 2.0), (2, 5.0), (2, 5.0)], "query_id int, s double")
    assert sorted((r.query_id, r.scaled) for r in scale_scores(df, "s").collect()) == [
        (1, 0.0), (1, 50.0), (1, 100.0), (2, 100.0), (2, 100.0)
    ]


def test_clip_results(spark):
    df = spark.createDataFrame([([("abcdef", 1)],)], "results array<struct<description:string, rank:int>>")
    assert df.select(clip_results("results", 3).alias("r")).first().r[0].description == "abc"
