import json

import pytest

from helpers import SKILLS
from matchloom.functions.skills import Skill, extract_skills, read_lexicon, skill_domains, word_lexicon
from matchloom.functions.taxonomy import FAMILIES, derive_family, label_relevance, matched_categories


@pytest.mark.parametrize(
    "title, family",
    [
        ("Registered Nurse", "HEALTHCARE"),
        ("Xylophone Tuning Coordinator", "OTHER"),
        ("Software Engineer", "ENGINEERING"),
        ("Project Manager, Infrastructure", "CONSTRUCTION"),
        ("Corporate Trainer", "FITNESS"),
        ("FP&A Lead", "FINANCE"),
        ("Nursery", "OTHER"),
        ("", "OTHER"),
        (None, "OTHER"),
    ],
)
def test_derive_family(one, title, family):
    assert one(derive_family("t"), t=title) == family

LEXICON = tuple(Skill(*entry) for entry in SKILLS)


def test_family_table():
    assert len(FAMILIES) == 24 and list(FAMILIES)[0] == "ACCOUNTANT" and list(FAMILIES)[-1] == "TEACHER"


@pytest.mark.parametrize(
    "category, title, label",
    [
        ("Information Technology", "Senior Software Engineer", 1),
        ("HR", "HR Manager", 1),
        ("HR", "Three Chefs", 0),
        ("Beekeeper", "Head beekeeper (urban)", 1),
        ("Beekeeper", "Beekeepers", 0),
        ("", "Nurse", 0),
        ("HR", "", 0),
    ],
)
def test_label_relevance(one, category, title, label):
    assert one(label_relevance("c", "t"), c=category, t=title) == label


def test_matched_categories(one):
    assert one(matched_categories("t"), t="Sales Engineer") == ["ENGINEERING", "SALES"]


def test_symbol_skills(one):
    assert set(one(extract_skills("t", LEXICON), t="C++, C#, .NET, and Node.js")) == {"c++", "c#", ".net", "node.js"}
    assert one(extract_skills("t", LEXICON), t="I write ASP.NET.") == ["asp.net"]
    assert one(extract_skills("t", LEXICON), t="javascript, JS and NodeJS!") == ["javascript", "node.js"]
    assert one(extract_skills("t", LEXICON), t="sqlite mysqlx spark+") == []
    assert one(extract_skills("t", LEXICON), t=None) == []


def test_longest_alias_wins(one):
    lexicon = (Skill("learning", "x", ("learning",)), Skill("machine learning", "x", ("machine learning", "ml")))
    assert one(extract_skills("t", lexicon), t="machine learning") == ["machine learning"]
    assert one(extract_skills("t", lexicon), t="ML, learning") == ["learning", "machine learning"]


def test_lexicon_file_and_domains(spark, tmp_path):
    path = tmp_path / "lexicon.json"
    path.write_text("\n".join(json.dumps({"canonical": s.canonical, "domain": s.domain, "aliases": list(s.aliases)}) for s in LEXICON))
    assert sorted(read_lexicon(spark, str(path))) == sorted(LEXICON)
    df = spark.createDataFrame([("python",), ("unknown",)], "skill string")
    got = {r.skill: r.domains for r in skill_domains(df, LEXICON).collect()}
    assert got == {"python": ["programming"], "unknown": []}
    assert word_lexicon(["a"])[0].aliases == ("a",)


def test_pattern_equals_python_re(spark):
    """Same hits as one flat longest-first alternation in Python."""
    import re

    aliases = sorted({a.lower(): s.canonical for s in LEXICON for a in s.aliases}.items(), key=lambda p: -len(p[0]))
    flat = re.compile(r"(?<![a-z0-9+#])(?:" + "|".join(re.escape(a) for a, _ in aliases) + r")(?![a-z0-9+#])", re.I)
    texts = [
        "Java/JavaScript; sql server SQL, MS Excel.", "c++11 C# c## .net dot net", "R.N. rn, registered nurse; PMP",
        "continuous integration ci/cd docker k8s kubernetes", "xnode.js node.jsx node js", "apache spark spark, ml",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = dict(aliases)
    for row in df.select("t", extract_skills("t", LEXICON).alias("s")).collect():
        assert row.s == sorted({names[h.lower()] for h in flat.findall(row.t)})
