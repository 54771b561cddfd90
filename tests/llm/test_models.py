"""Quality and language classifiers: held-out accuracy, the fast formula, edge cases."""

import random

import numpy as np
import pytest

from matchloom.llm import language_id, quality

SYLLABLES = {
    "en": "the and ing er tion that ly with".split(),
    "de": "der und ung sch lich ein ät zu".split(),
    "fr": "le que é ment eau les oi dans".split(),
}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 60)), lang) for i in range(n)]


def test_languages(spark):
    model = language_id.fit(spark.createDataFrame(corpus(1, 300), "doc_id long, text string, lang string"), per_language=50)
    rows = corpus(2, 150)
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 !! \n", None), (903, "日本語" * 3, None), (904, "der und " * 200_000, "de")]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "7 AS score")
    got = {r.doc_id: r for r in language_id.predict_language(frame, model).collect()}
    assert len(got) == 155 and np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred in SYLLABLES and got[903].rejected and got[904].lang_pred == "de"


def test_language_without_training(spark):
    nothing = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    model = language_id.fit(nothing)
    assert model is None
    assert {r.lang_pred for r in language_id.predict_language(nothing, model).collect()} == {"und"}
    assert language_id.predict_language(nothing.filter("false"), model).count() == 0


def test_sample_is_bounded_and_of_distinct_texts(spark):
    rows = [(i, "same text", "en") for i in range(200)] + [(i, f"text {i}", "de") for i in range(200)]
    got = language_id._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10).collect()
    assert sorted((r.lang, 1) for r in got) == [("de", 1)] * 10 + [("en", 1)]


def test_clusters_are_unit_length():
    rows = np.eye(6)[[0, 0, 1, 1, 2, 5]]
    centres = language_id.clustered(rows, 4)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1) and len(centres) == 4
    assert (rows @ centres.T).max(axis=1).min() > 0.99


def junk(rng, words):
    return " ".join(w + rng.choice(["&&&", "###", "%%%"]) for w in text(rng, "en", words).split())


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(5)
    return [(i, text(rng, "en", n), 1) if rng.random() < 0.8 else (i, junk(rng, n), 0) for i in range(500) for n in [rng.randint(5, 80)]]


def test_quality(spark, labelled):
    frame = spark.createDataFrame(labelled, "doc_id long, text string, quality int").selectExpr("*", "length(text) AS n_chars")
    model = quality.fit(frame.filter("doc_id < 400"), "quality", ("n_chars",))
    rest = frame.filter("doc_id >= 400").selectExpr("*", "'x' AS score")
    odd = spark.createDataFrame([(900, None, 1, None), (901, "", 1, 0)], "doc_id long, text string, quality int, n_chars int")
    got = quality.score(rest.drop("score").unionByName(odd).selectExpr("*", "'x' AS score"), model, ("n_chars",)).collect()
    good = [r.score for r in got if r.quality == 1 and r.doc_id < 900]
    bad = [r.score for r in got if r.quality == 0]
    assert min(good) > max(bad) and min(good) >= 0.3 > max(bad)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 102


def test_the_quality_sample_is_narrow_on_the_driver(spark, labelled, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, labels: seen.extend(rows))
    quality.fit(spark.createDataFrame(labelled, "doc_id long, text string, quality int"), "quality")
    assert {(s.dtype, v.dtype) for s, v in seen} == {(np.dtype(np.int32), np.dtype(np.float32))}
    want = sorted(sorted(quality.features(t)[0].tolist()) for _, t, _ in labelled)
    assert sorted(sorted(s.tolist()) for s, _ in seen) == want


def test_quality_without_labels(spark):
    frame = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, quality int")
    sample = quality.sample_of(frame, "quality")
    assert sample.count() == 0
    model = quality.fit(frame.drop("quality").join(sample, "doc_id"), "quality")
    assert model is None and [r.score for r in quality.score(frame, model).collect()] == [0.5]
    assert quality.score(frame.filter("false"), model).count() == 0


def test_linear_time_formula(labelled):
    rows = [quality.features(t) for _, t, _ in labelled[:40]]
    model = quality.train(rows, np.array([q for _, _, q in labelled[:40]], float), epochs=2)
    starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows])[:-1]])
    fast = model.score(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]).astype(float), starts)
    for (slots, values), score in zip(rows[:5], fast):
        v = model.factors[slots] * values[:, None].astype(float)
        pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
        z = model.bias + float(model.weights[slots] @ values) + pairs
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-6


def test_features_never_see_other_columns():
    slots, values = quality.features("Some text, here.", {"n_chars": None, "other": "x"})
    assert len(slots) == len(values) and slots.max() < quality.SLOTS
    assert np.isfinite(quality.features("\ud800 lone", {"n": float("nan")})[1]).all()
    assert np.isfinite(quality.features(None)[1]).all()
