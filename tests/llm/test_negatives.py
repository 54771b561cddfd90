"""Hard negatives against brute force; the residue product against plain integers."""

import random

import numpy as np
import pytest

from matchloom.llm import negatives
from matchloom.llm.negatives import ResidueRows, hard_negatives, scores, whole_vectors

SCHEMA = "vec_id long, label int, vec array<long>"


@pytest.mark.parametrize("width,most", [(1, 1), (7, 5), (64, 160), (3000, 300), (20, 10**9), (33, 2**62)])
def test_residue_product_is_exact(width, most):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-most, most, (9, width), endpoint=True), rng.integers(-most, most, (13, width), endpoint=True)
    a[0], b[0], b[1] = most, most, -most
    want = a.astype(object) @ b.T.astype(object)
    assert (scores(ResidueRows(a), ResidueRows(b)).astype(object) == want).all()
    assert (scores(ResidueRows(a), ResidueRows(b), slice(2, 5)).astype(object) == want[2:5]).all()


def test_residue_product_of_nothing():
    empty, some = np.zeros((0, 4), np.int64), np.ones((2, 4), np.int64)
    assert scores(ResidueRows(empty), ResidueRows(some)).shape == (0, 2)
    assert (scores(ResidueRows(np.zeros((2, 0), np.int64)), ResidueRows(np.zeros((3, 0), np.int64))) == np.zeros((2, 3))).all()
    assert (scores(ResidueRows(np.zeros((2, 4), np.int64)), ResidueRows(some)) == 0).all()


def by_hand(rows, every, positives, wanted, low, high):
    out = []
    for anchor, label, vec in rows:
        if anchor % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(vec, v)), i, lab == label) for i, lab, v in rows if i != anchor and len(v) == len(vec))
        for score, positive, _ in [f for f in found if f[2]][:positives]:
            inside = [f for f in found if not f[2] and low * -score <= 100 * -f[0] <= high * -score][:wanted]
            out += [(anchor, positive, n, f[1], -score, -f[0]) for n, f in enumerate(inside, 1)]
    return sorted(out)


def some_rows(n, seed, spread=40):
    rng = random.Random(seed)
    return [(i, rng.choice([0, 0, 0, 1, 2]), [rng.randint(-spread, spread) + 15 for _ in range(6)]) for i in range(n)]


@pytest.mark.parametrize("block,chunk,slab", [(8192, 8192, 256), (37, 5, 2), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, block, chunk, slab):
    monkeypatch.setattr(negatives, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS_PER_CHUNK", chunk)
    monkeypatch.setattr(negatives, "_SLAB", slab)
    n = 300 if block > 1 else 30
    # ties, repeated rows, another width, an anchor that is alone with its label
    rows = some_rows(n, block) + [(n + 1, 0, [15] * 6), (n + 2, 0, [15] * 6), (7, 0, [1, 2]), (20, 0, [2, 2]), (n + 10, 9, [20] * 6)]
    rows += [(n + 3, 1, [9] * 6)] * 2 + [(n + 4, 2, [0] * 6)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10, positives=3, negatives=4, low=30, high=90).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, 10, 3, 4, 30, 90)


def test_whole_vectors_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, -0.001]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [nan, 1.0]), (4, 1, [inf, 0.0]), (5, 1, [None, 0.0]), (None, 1, [1.0, 1.0]), (6, 2, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, anchor string")
    assert {(r.vec_id, tuple(r.vec)) for r in whole_vectors(table).collect()} == {(0, (128, -1)), (6, ())}


def test_nothing_to_do(spark):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    empty = hard_negatives(spark.createDataFrame([], SCHEMA))
    assert empty.columns == columns and empty.count() == 0
    assert hard_negatives(spark.createDataFrame([(1, 0, [1])], SCHEMA)).count() == 0  # no anchor
    assert hard_negatives(spark.createDataFrame([(100, 0, [1])], SCHEMA)).count() == 0  # no other row
    assert hard_negatives(spark.createDataFrame([(0, 0, []), (1, 0, []), (2, 1, [])], SCHEMA), every=5).collect()[0][:4] == (0, 1, 1, 2)


def test_repeated_anchors_and_text_labels(spark):
    rows = [(0, "a", [3]), (0, "a", [3]), (1, "a", [5]), (2, "b", [4]), (3, "b", [1])]
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, label string, vec array<long>"), every=10).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 2, 15, 12)] * 2
