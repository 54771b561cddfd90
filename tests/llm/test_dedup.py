"""Exact and near deduplication against brute force."""

import hashlib
import itertools
import random
import time
import re

import numpy as np
import pytest

from matchloom.llm.components import components
from matchloom.llm.exact_dedup import ContentTable, drop_copies, exact_dedup, grouped
from matchloom.llm.minhash_dedup import drop_near_copies, near_dedup, near_groups, parity_map
from matchloom.llm.shingles import OnePermutation, overlap, shingle_set, word_hashes

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact_expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(BLANK.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for doc_id, text in rows:
        norm = BLANK.sub("", text or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((doc_id, keep, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out


EXACT = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, "  "), (7, "é b"), (8, "éb"), (9, "a b"),
    (10, "x" * 50_000), (11, "x" * 49_999 + " x"), (12, "zz"), (12, "zz"), (None, "zz"), (None, "q"), (13, "y"), (14, " y"), (15, "y "),
]


@pytest.mark.parametrize("memory", [1 << 27, 3000])
def test_exact(docs_of, memory):
    got = exact_dedup(docs_of(EXACT), memory).collect()
    key = lambda r: (str(r[0]), r[3], str(r[1]))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(exact_expected(EXACT), key=key)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({k[1] for k in kept})


def test_exact_random_with_spills(docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 5)))) for i in range(600)]
    got = exact_dedup(docs_of(rows).repartition(5), 2000).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(exact_expected(rows))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_edges(spark, docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    clash = spark.createDataFrame([(1, "a", "x", True), (2, "a ", "y", False)], "doc_id long, text string, KEEP_ID string, kept boolean")
    assert exact_dedup(clash).columns == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    assert [tuple(r) for r in drop_copies(clash).collect()] == [(2, "a ", "y", False)]
    assert drop_copies(clash).columns == clash.columns


def test_content_table_compares_content():
    table = ContentTable()
    for content in (b"a", b"b", b"a"):
        table.add((7, content, 1, 1, 1, 1, 1))  # one hash for all
    assert [(e[1], e[2]) for e in table.entries] == [(b"a", 2), (b"b", 1)]
    records = [(7, str(i % 50).encode() * 100, 1, 1, i, i, 1) for i in range(500)]
    assert sorted(e[2] for e in grouped(iter(records), 500)) == [10] * 50


def near_expected(rows):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x & y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets if d is not None)


def family(seed, size, words=80, edits=4):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 40)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(own)


def test_near_against_brute_force(docs_of):
    texts = [t for s in range(4) for t in family(s, 60, 40 + 30 * s, 1 + s)]
    texts += ["", None, "  \n", "one", "One", "one two", "ONE\ttwo", "a b c d e", "a b c d e f", "É b c d e", "é b c d e"]
    rows = list(enumerate(texts, 1000))
    random.Random(1).shuffle(rows)
    result, links = near_groups(docs_of(rows).repartition(3))
    got = result.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_expected(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert links.columns == ["a", "b"]


def test_near_edges(spark, docs_of):
    assert near_dedup(docs_of([])).count() == 0
    assert [tuple(r) for r in near_dedup(docs_of([(4, None), (None, "")])).orderBy("doc_id").collect()] == [
        (None, 0, None, True), (4, 0, 4, True)]
    rows = [(1, "a b c"), (1, "x y z"), (2, "x Y z"), (None, "a b c"), (3, "q")]
    assert sorted((str(r.doc_id), r.component_id) for r in near_dedup(docs_of(rows)).collect()) == [
        ("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", 1)]
    clash = spark.createDataFrame([(5, "a b", 1), (6, "A B", 2)], "doc_id long, text string, component_id int")
    assert [tuple(r) for r in drop_near_copies(clash).collect()] == [(5, "a b", 1)]


def test_words_and_shingles():
    assert len(word_hashes("a b c\x0bd")) == 3
    x, y = word_hashes("The  CAT É sat"), word_hashes("the cat É\nsat")
    assert (x == y).all() and len(set(x.tolist())) == 4
    long = "word " * 300_000 + "x" * 3_000_000 + " end"
    assert len(word_hashes(long)) == 300_002 and len(set(word_hashes(long).tolist())) == 3
    a, b = shingle_set("a b c d e f"), shingle_set("b c d e f g")
    assert (len(a), len(b), overlap(a, b)) == (2, 2, 1)


def test_parity_map_bounds_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2000, 300).astype(np.uint64))
        y = np.unique(rng.integers(0, 2000, 300).astype(np.uint64))
        differ = sum(int(v).bit_count() for v in (parity_map(x) ^ parity_map(y)).view(np.uint64))
        assert differ <= len(set(x.tolist()) ^ set(y.tolist()))


def test_signature_agrees_as_often_as_similar():
    minhash, rng = OnePermutation(24, 5), np.random.default_rng(1)
    agree = []
    for n in (3, 20, 400):
        for _ in range(60):
            values = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            x, y = np.unique(values[: int(1.5 * n)]), np.unique(values[n // 2 :])
            true = overlap(x, y) / len(set(x.tolist()) | set(y.tolist()))
            agree.append(np.mean(minhash.signature(x) == minhash.signature(y)) - true)
    assert abs(np.mean(agree)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_boilerplate_that_does_not_link(spark, docs_of):
    """Texts that share most words but not enough: found apart, without comparing all with all; true copies among them
    are still found."""
    rng = random.Random(6)
    common = " ".join(f"legal{i}" for i in range(170))
    rows = [(i, f"{common} " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(30))) for i in range(3000)]
    rows += [(10_000 + i, rows[i * 7][1] + f" tail{i}") for i in range(100)]
    began = time.time()
    got = {r.doc_id: r.component_id for r in near_dedup(docs_of(rows)).collect()}
    assert time.time() - began < 120
    assert all(got[10_000 + i] == i * 7 for i in range(100)) and all(got[i] == i for i in range(3000))


def test_rare_pairs_lose_no_link(spark, monkeypatch):
    """With the smallest of everything, each link between sets of different components is among the pairs."""
    from pyspark.sql import functions as F

    from matchloom.llm import minhash_dedup
    from matchloom.llm.shingles import overlap, shingle_set, similar

    monkeypatch.setattr(minhash_dedup, "PIECE", 7)
    monkeypatch.setattr(minhash_dedup, "ORDER_SHINGLES", 50)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(40)}" for _ in range(60)] for _ in range(4)]
    sets = []
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        sets.append(shingle_set(" ".join(words)))
    nodes = [(i, i % 60, len(s), *parity_map(s).tolist()) for i, s in enumerate(sets)]
    ddl = "node long, component long, n_shingles long, " + ", ".join(f"m{i} long" for i in range(8))
    hashes = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, n long, hashes binary")
    found = minhash_dedup._rare_pairs(spark.createDataFrame(nodes, ddl), hashes, 85).select(F.col("a"), F.col("b")).distinct()
    pairs = {(r.a, r.b) for r in found.collect()}
    links = [(i, j) for i in range(150) for j in range(i) if similar(len(sets[i]), len(sets[j]), overlap(sets[i], sets[j]), 85)]
    assert links
    for i, j in links:
        assert i % 60 == j % 60 or (j, i) in pairs
