"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import pytest

from matchloom.llm import phrases
from matchloom.llm.phrases import collocations, compacted, gram_weights, path_phrases, phrase_counts

SCHEMA = "lang string, text string"


def grams(rows, longest):
    found = {}
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    found.setdefault(lang or "und", Counter())[tuple(words[i : i + size])] += 1
    return found


def by_hand(rows, longest, least, covered, first):
    out = set()
    for lang, f in grams(rows, longest).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        kept = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            score, _, l, r = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            longer = [c for h, c in f.items() if len(h) > len(g) and c >= least and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * c >= covered * a for c in longer):
                kept.append((-score, -a, " ".join(g).encode(), a, l, r, n, score))
        out |= {(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(kept)[:first], 1)}
    return out


def some_rows():
    rng = random.Random(3)
    words = ["the", "New", "york", "city", "of", "é", "and", "İx", "a-b", "日本"] + [f"r{i}" for i in range(300)]
    rows = []
    for i in range(260):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(words[:10] if rng.random() < 0.8 else words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \x0c"])
        rows.append((rng.choice(["en", "de", None, "und"]), text + rng.choice(["", "new york city", "New\tYork City hall of fame"])))
    return rows + [("en", None), ("en", ""), (None, "..;!"), ("xx", " \t "), rows[0], rows[0], ("de", "na " * 500), ("de", "la li lu " * 200)]


@pytest.mark.parametrize("longest,least,first", [(3, 10, 2000), (2, 3, 7), (4, 5, 2000), (5, 2, 2000)])
def test_against_counting(spark, longest, least, first):
    rows = some_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collocations(docs, longest, least, 50, first).collect()
    assert {tuple(r) for r in got} == by_hand(rows, longest, least, 50, first) and len(got) == len({tuple(r) for r in got})


def test_counts_do_not_depend_on_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_BITS", 64)
    monkeypatch.setattr(phrases, "MAX_BITS", 64)  # as good as full: nothing is cut early
    monkeypatch.setattr(phrases, "BATCH_BYTES", 200)
    rows = some_rows()
    counts, _ = phrase_counts(gram_weights(spark.createDataFrame(rows, SCHEMA), 3, 4), 3, 4)
    want = {(lang, len(g), " ".join(g), n) for lang, f in grams(rows, 3).items() for g, n in f.items() if n >= 4}
    assert {(r.lang, r.size, r.gram, r.n) for r in counts.collect()} == want


def test_unary_paths(spark):
    chain = [("x", f"w{i} w{i + 1} w{i + 2}", 10 + i) for i in range(40)]
    fork = [("x", "w41 w42 a", 5), ("x", "w41 w42 b", 6)]
    ring = [("x", "p q r", 3), ("x", "q r p", 3), ("x", "r p q", 3), ("x", "z z z", 9), ("y", "w0 w1 w2", 8)]
    paths = compacted(spark.createDataFrame(chain + fork + ring, "lang string, gram string, n long"))
    assert paths.count() == len(chain + fork + ring)
    found = {(r.lang, r.phrase): (r.edges, r.least, r.most) for r in path_phrases(paths).collect()}
    assert found[("x", " ".join(f"w{i}" for i in range(42)))] == (40, 10, 49)
    assert found[("x", "w41 w42 a")] == (1, 5, 5) and found[("y", "w0 w1 w2")] == (1, 8, 8) and found[("x", "z z z")] == (1, 9, 9)
    rings = [p for (_, p), e in found.items() if e == (3, 3, 3)]
    assert len(rings) == 1 and len(rings[0].split()) == 5 and set(rings[0].split()) == {"p", "q", "r"}
    assert len(found) == 6


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    weights = spark.createDataFrame(
        [("x", 2, "a b", big), ("x", 1, "a", 7), ("x", 1, "b", big + 5), ("x", 0, "", 3 * big)], "lang string, size byte, gram string, n long"
    )
    counts, _ = phrase_counts(weights, 2, 10)
    assert {(r.gram, r.n) for r in counts.collect()} == {("a b", big), ("a", big + 7), ("b", big + 5)}
    expression = "(cast(n as decimal(15,0)) * cast(n as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(n + 7 as decimal(15,0)) * cast(n + 5 as decimal(15,0)))"
    assert counts.filter("gram = 'a b'").selectExpr(f"{expression} AS s").first().s == 10**6 * big * big // ((big + 7) * (big + 5))


def test_empty_and_other_columns(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("n", 1, "ab cd ef " * 30, "en")]
    docs = spark.createDataFrame(rows, "gram string, rank int, text string, lang string")
    assert {tuple(r) for r in collocations(docs).collect()} == by_hand([("en", rows[0][2])], 3, 10, 50, 2000)


def test_very_long_text(spark):
    rows = [("en", "alpha beta gamma delta " * 60_000), ("en", "x" * 3_000_000 + " y")]
    got = collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == by_hand(rows, 3, 10, 50, 2000)
