"""Base spans against the plain patterns, the label model on votes with known answers, and added spans."""

import hashlib
import random
import re
import time

import numpy as np

from matchloom.llm.pii import KINDS, LABELERS, base_spans, candidates, code_of, estimate, find_personal_data, fit, redacted, spans, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), number, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    letters = ["a", "Z", "9", "1", "0", "4", "255", "25", ".", ".", "@", "@", "-", " ", "+", "(", ")", "%", "é", "\n", "_", "4111111111111111", "+1 (988) 555-2485", "a@b.c"]
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert [(c.start, c.kind, c.end) for c in base_spans(text)] == plain(text), text


def test_time_is_linear_on_hostile_texts():
    for unit in ("a", "1", "1.", "1 ", "@", "a@", "a@b", "+1", "+1(", "1-", ".", "a at b dot ", "f:", "1[.]", "a.", "(1", "[at]", "a@b.c "):
        began = time.time()
        candidates(unit * (400_000 // len(unit)))
        assert time.time() - began < 20, unit


def test_votes_with_known_answers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.4
    right, speaks = [0.95, 0.7, 0.8, 0.55], [0.9, 0.8, 0.5, 0.6]
    cast = np.zeros((len(truth), 4), np.int64)
    for i in range(4):
        vote = np.where(rng.random(len(truth)) < right[i], truth, ~truth)
        cast[:, i] = np.where(rng.random(len(truth)) < speaks[i], 2 * vote.astype(int) - 1, 0)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = estimate(patterns, counts.astype(float))
    found = list(model.reliability().values())
    assert np.allclose(found, right, atol=0.03) and abs(model.prior - truth.mean()) < 0.03
    assert ((model.posterior(cast) > 0.5) == truth).mean() > 0.93


def test_classifier_learns_soft_labels():
    rows = [[0, 10 + i % 3, 20] for i in range(300)]
    soft = np.array([[0.95, 0.5, 0.05][i % 3] for i in range(300)])
    weights = train(rows, soft, epochs=800)
    z = [1 / (1 + np.exp(-weights[r].sum())) for r in rows[:3]]
    assert np.allclose(z, [0.95, 0.5, 0.05], atol=0.06)
    assert not train([], np.zeros(0)).any()


def corpus():
    rng = random.Random(8)
    words = "over the lazy hill we went and saw nothing of note in that long year".split()
    filler = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(1200):
        name, host = rng.choice(["ann", "bob.k", "zoe_1"]), rng.choice(["mail", "post-1", "shop"])
        made = [
            f"please contact {name}@{host}.example.com today", f"phone: +1 ({number(3)}) 555-{number(4)} anytime", f"from server {rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7 again",
            f"call ({number(3)}) 555-{number(4)} or tel. 030-{number(3)}-{number(4)} now", f"e-mail {name} [at] {host} [dot] org please", f"version 1.{rng.randint(300, 999)}.{rng.randint(0, 9)}.2 of it",
            f"order {number(4)}-{number(4)}", f"on 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} it rained", filler(), filler(), filler(),
        ]
        rows.append((i, f"{filler()} {made[i % len(made)]} {filler()}."))
    return rows


def test_added_spans(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = fit(docs)
    assert all(set(m.reliability()) == set(LABELERS) for m in model.labelers.values())
    asked = {
        "write an e-mail to joe [at] site [dot] org soon": "email:19:42", "call us: (415) 555-0134 today": "phone:9:23",
        "on 2024-05-11 it rained": "", "version 1.300.4.2 of it": "", "nothing here at all, dot com": "", "order 1234-5678": "",
    }
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in find_personal_data(frame, model).collect()}
    assert [got[i] for i in range(len(asked))] == list(asked.values())
    # copies of the table in other partitions give the same model
    again = fit(docs.repartition(7))
    assert np.allclose(model.weights, again.weights)
    found = {r.doc_id: r for r in find_personal_data(docs, model).collect()}
    assert all("phone" in found[i].spans for i, t in rows if "phone: +1" in t) and not any(found[i].spans for i, t in rows if re.search("rained|order|version", t) or not re.search("[0-9@]", t) and "[at]" not in t)


def test_rows_and_edge_cases(spark):
    texts = [None, "", "no data", "mail a@b.co and 10.0.0.256 or 10.0.0.25", "é 4111 1111 1111 1111 +49 30 1234567", "𝔘🎉 a@b.co"]
    texts += ["filler " * 200_000 + "z@y.com"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, texts[3], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email long")
    got = find_personal_data(docs, None).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r[0] for r in rows)))
    by_text = {r[0]: r[1] for r in rows}
    for r in got:
        want = plain(by_text[r.doc_id] or "")
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert (r.spans, r.base_sha256) == (line, hashlib.sha256(line.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert fit(docs.filter("text = 'no data'")) is None and fit(docs.limit(0)) is None
    assert find_personal_data(docs.limit(0), None).count() == 0


def test_redacted_and_votes(spark):
    docs = spark.createDataFrame([(1, "to a@b.co, or +1 (988) 555-2485!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in redacted(docs, None).orderBy("doc_id").collect()] == ["to <email>, or <phone>!", None]
    assert spans(None, None) == ([], []) and code_of([-1, 0, 1]) == 0 + 3 + 18
