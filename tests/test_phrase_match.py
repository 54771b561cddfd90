"""Dictionary matches by join against the pattern form of the same lexicon."""

import random

from pyspark.sql import functions as F

from helpers import SKILLS, rows
from matchloom.functions.skills import Skill, extract_skills
from matchloom.operators.phrase_match import find_categories, find_phrases, find_skills, read_lexicon_table
from matchloom.operators.sampling import category_matches

LEXICON = (*(Skill(*entry) for entry in SKILLS), Skill("deep learning", "ml", ("deep learning", "machine learning basics")), Skill("c", "programming", ("c",)))


def lexicon_rows(spark, lexicon):
    return spark.createDataFrame([(s.canonical, s.domain, list(s.aliases)) for s in lexicon], "canonical string, domain string, aliases array<string>")


def test_equals_the_pattern(spark):
    rng = random.Random(4)
    bits = [a for s in LEXICON for a in s.aliases] + ["Java", "C++", "net", "x", "learning", "basics", "r.n", "ml", "1"]
    glue = [" ", " ", ".", ", ", "-", "/", "", "\n", "+", "#", "é"]
    texts = [None, "", " ", ".", "asp.net .net x.net", "C++, c#; C", "machine learning basics deep learning"]
    texts += ["".join(rng.choice(bits) + rng.choice(glue) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = rows(frame.select("id", extract_skills("text", LEXICON)))
    assert rows(find_skills(frame, lexicon_rows(spark, LEXICON))) == want


def test_places_and_nothing_to_find(spark):
    frame = spark.createDataFrame([(1, "New York, new york"), (2, None)], "id long, text string")
    found = find_phrases(frame, spark.createDataFrame([("NEW YORK",), ("york",), (None,), (" ",)], "phrase string"))
    assert rows(found) == [(1, 0, "new york"), (1, 5, "new york")]
    assert rows(find_phrases(frame, spark.createDataFrame([], "phrase string"))) == []
    assert rows(find_skills(frame, lexicon_rows(spark, ()))) == [(1, []), (2, [])]


def test_many_aliases(spark, tmp_path):
    lexicon = spark.range(50_000).select(
        F.concat(F.lit("skill"), "id").alias("canonical"), F.lit("d").alias("domain"),
        F.array(F.concat(F.lit("word"), "id"), F.concat(F.lit("two words "), "id")).alias("aliases"),
    )
    lexicon.write.json(str(tmp_path / "lexicon"))
    frame = spark.createDataFrame([(1, "Word7 and two words 49999!"), (2, "word50000 two words")], "id long, text string")
    got = find_skills(frame, read_lexicon_table(spark, str(tmp_path / "lexicon")))
    assert rows(got) == [(1, ["skill49999", "skill7"]), (2, [])]


def test_shared_aliases_give_all_skills(spark):
    frame = spark.createDataFrame([(1, "go")], "id long, text string")
    assert rows(find_skills(frame, lexicon_rows(spark, (Skill("golang", "p", ("go",)), Skill("go game", "g", ("Go",)))))) == [(1, ["go game", "golang"])]


def test_categories_equal_the_pattern(spark):
    taxonomy = {"A": ("data engineer", "etl"), "B": ("nurse",), "C": ("c++ developer", "engineer")}
    titles = ["Senior Data Engineer", "Nurse (ICU)", "ETL", None, "", "engineering", "C++  Developer / data", "data-engineer", "nurse"]
    frame = spark.createDataFrame(list(enumerate(titles)), "job_id long, job_title string")
    known = spark.createDataFrame([(c, k) for c, ks in taxonomy.items() for k in ks] + [("D", " "), ("E", None)], "category string, keyword string")
    got = find_categories(frame, known).select("job_id", "category")
    assert rows(got) == rows(category_matches(frame, taxonomy).select("job_id", "category"))
    many = spark.range(5000).select(F.concat(F.lit("C"), "id").alias("category"), F.concat(F.lit("kw"), "id").alias("keyword"))
    assert rows(find_categories(spark.createDataFrame([(1, "kw4999 x kw3")], "job_id long, job_title string"), many).select("category")) == [("C3",), ("C4999",)]
    assert find_categories(frame, known.limit(0)).count() == 0


def test_chains_of_overlaps_and_no_row_of_an_impossible_phrase(spark):
    """Matches that overlap are settled along the whole chain; runs that are no phrase are not shuffled."""
    phrases = spark.createDataFrame([("a b",), ("b c",), ("c d e",), ("e",), ("x",)], "phrase string")
    text = "a b c d e " * 40 + "x"
    texts = spark.createDataFrame([(1, text), (2, "b c d e x"), (3, "zz " * 50)], "id long, text string")
    found = find_phrases(texts, phrases)
    got = sorted((r.id, r.place, r.phrase) for r in found.collect())
    want = [(1, p * 10 + at, w) for p in range(40) for at, w in ((0, "a b"), (4, "c d e"))] + [(1, 400, "x")]
    assert got == want + [(2, 0, "b c"), (2, 6, "e"), (2, 8, "x")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "_chain" in plan
