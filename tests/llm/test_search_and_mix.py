"""Search and mixing against brute force."""

import math
import random
import re

import numpy as np
import pytest

from matchloom.llm.knn_join import best, products, top_k
from matchloom.llm.mixing import mix, mixed, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_top(rows, k):
    fine = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in fine:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(n, width, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, spread, width)]) for i in range(n)]


def test_top_k(spark):
    rows = vectors(700, 8, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [None, 1.0] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    rows += [(3000, [1.0, 2.0]), (3001, [1.0, 0.5]), (3050, [4.0, -1.0])]  # another width
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for pivots in (1, 7, 64):
        assert sorted(map(tuple, top_k(frame, 5, 50, pivots).collect())) == expected_top(rows, 5)


def test_top_k_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty).count() == 0 and top_k(empty).columns == ["query_id", "rank", "vec_id", "score"]
    few = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    assert sorted(map(tuple, top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect())) == expected_top(few, 5)


def test_products_stay_exact():
    big = np.array([[2**31, 3], [-(2**31), 7]], np.int64)
    assert products(big, big)[0, 1] == int(big[0, 0]) * int(big[1, 0]) + 21  # fits 64 bits, not a double
    small = np.array([[5, -7], [2, 9]], np.int64)
    assert products(small, small).tolist() == [[74, -53], [-53, 85]]
    row, column = best(np.array([[3, 9, 9, 1]]), np.array([4, 8, 2, 1]), np.array([1]), 2)
    assert row.tolist() == [0, 0] and column.tolist() == [2, 1]


def water_filling(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "src10", "src2"]
    sizes = {n: rng.choice([0, 5, 100, 3000, 10**6]) for n in names[: rng.randint(1, 8)]}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = water_filling(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def table(spark, seed=0, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    rows += [(900, None, "a"), (901, " \n", "b"), (902, "x y", "only"), (955, "twin", "b"), (955, "twin", "b"), (None, "no id", "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(spark):
    rows, frame = table(spark)
    result, slots = mix(frame)
    got = result.collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        i = [x for x in rows if x[0] == r.doc_id]
        assert r.size == len(WORD.findall(i[0][1] or "")) and 0 <= r.taken <= 2 * r.size
        sizes[i[0][2]] = r.source_size
        taken[i[0][2]] = taken.get(i[0][2], 0) + r.taken
    want = water_filling({s: sum(len(WORD.findall(x[1] or "")) for x in rows if x[2] == s) for s in sizes})
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.02 * target + 3
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mix(frame.repartition(5))[0].collect()))
    # any run of slots is close to the weights
    order = [r.key for r in slots.orderBy("slot").collect()]
    total = sum(want.values())
    for at in range(0, len(order) - 256, 199):
        for source, target in want.items():
            share = order[at : at + 256].count("" if source is None else "=" + source) / 256
            assert abs(share - target / total) < 0.05


def test_mixed_rows(spark):
    rows, frame = table(spark, 1)
    extra = frame.selectExpr("*", "1 AS `row`", "'k' AS `key`")
    got = mixed(extra)
    assert got.columns == extra.columns
    words = {}
    for r in got.collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    want = water_filling({s: sum(len(WORD.findall(x[1] or "")) for x in rows if x[2] == s) for s in {x[2] for x in rows}})
    for source, target in want.items():
        assert abs(words.get(source, 0) - target) <= 0.05 * target + 50  # whole documents


@pytest.mark.parametrize("tiny", [[7], [3, 2, 4], [40] * 30])
def test_mix_of_huge_and_tiny_sources(spark, tiny, monkeypatch):
    monkeypatch.setattr("matchloom.llm.mixing.MIN_SLOTS", 64)  # blocks of about 2,000 words
    rows = [(i, "w " * 500, "huge") for i in range(180)] + [(1000 + i, "w " * n, "tiny") for i, n in enumerate(tiny)]
    rows += [(2000, "w " * 2500, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    result, slots = mix(frame)
    source = {r[0]: r[2] for r in rows}
    taken, sizes = {}, {"huge": 90000, "tiny": sum(tiny), "z": 2500}
    for r in result.collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    want = water_filling(sizes)
    largest = {"huge": 500, "tiny": max(tiny), "z": 2500}
    for name, target in want.items():
        assert abs(taken[name] - target) <= min(largest[name], 0.01 * target) + 0.5
    turns = {}
    for r in slots.collect():
        turns.setdefault(r.key, []).append(r.rank)
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in turns.values()) and len(turns) == 3
    assert {source[r.doc_id] for r in mixed(frame).collect()} == set(sizes)


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty)[0].count() == 0 and mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r)[1:] for r in mix(blank)[0].collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixed(blank).count() == 0


def test_queries_meet_only_the_cells_of_their_group(spark):
    """Each query cell visits a list of its own, and far from all cells where the vectors are clustered."""
    import numpy as np

    from matchloom.llm.knn_join import _bundles, _with_cell, visited

    rng = np.random.default_rng(2)
    points = rng.integers(-900, 900, (16, 8))
    rows = [(i, (points[i % 16] + rng.integers(-3, 4, 8)).tolist()) for i in range(1600)]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    celled = frame.mapInArrow(_with_cell(points), "vec_id long, vec array<long>, cell int, distance double")
    counts, radii = np.zeros(16, np.int64), np.zeros(16)
    for r in celled.collect():
        counts[r.cell] += 1
        radii[r.cell] = max(radii[r.cell], r.distance)
    lists = {}
    for r in visited(celled.filter("vec_id % 10 < 5"), points, counts, radii, 5).collect():
        lists.setdefault(r.group, set()).add(r.cell)
    assert len(lists) == 16 and sum(map(len, lists.values())) <= 40
    assert _bundles({3: 5000, 1: 5000, 2: 100, 7: 20_000}) == {1: 0, 2: 0, 3: 1, 7: 2}
