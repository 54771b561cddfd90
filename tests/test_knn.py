import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators.encoding import check_vectors, encode_incremental, hashing_encoder, model_encoder
from matchloom.operators import knn
from matchloom.operators.knn import best_of_cells, best_of_tile, knn_ann, knn_exact, knn_exact_unlike, pack_cells
from matchloom.operators.metrics import recall_at_k


def brute(queries, items, k):
    want = []
    for q, vec in queries:
        scored = sorted(((-round(float(np.dot(np.float64(vec), np.float64(v))), 6) + 0.0, i) for i, v in items))[:k]
        want += [(q, i, -s + 0.0, rank) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(want)


def frames(spark, queries, items, parts=4):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id long, vec array<float>").repartition(parts)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in items], "item_id long, vec array<float>").repartition(parts)
    return q, x


def got(df):
    return sorted((r.query_id, r.item_id, r.score + 0.0, r.retrieval_rank) for r in df.collect())


def unit(rng, n, dim):
    m = rng.normal(size=(n, dim)).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("cells, block, chunk", [(1, 1000, 1000), (12, 7, 5), (40, 50, 3)])
def test_exact_equals_brute_force(spark, cells, block, chunk):
    rng = np.random.default_rng(42)
    items = list(enumerate(unit(rng, 120, 8)))
    queries = list(enumerate(unit(rng, 15, 8)))
    q, x = frames(spark, queries, items)
    assert got(knn_exact(q, x, 5, cells, block, chunk)) == brute(queries, items, 5)


def test_exact_with_clusters_and_copies(spark):
    """A third of the vectors are one vector; the rest are tight clusters, so cells are pruned."""
    rng = np.random.default_rng(7)
    centers = unit(rng, 6, 16)
    clustered = [centers[i % 6] + rng.normal(scale=0.02, size=16).astype(np.float32) for i in range(120)]
    items = list(enumerate([np.float32(v / np.linalg.norm(v)) for v in clustered] + [centers[0]] * 60))
    queries = list(enumerate([centers[0], centers[3], -centers[1]]))
    q, x = frames(spark, queries, items)
    assert got(knn_exact(q, x, 10, 12, 16, 2)) == brute(queries, items, 10)


def test_exact_with_any_norms_and_edges(spark):
    rng = np.random.default_rng(3)
    items = list(enumerate(unit(rng, 60, 4) * rng.uniform(0.1, 5, size=(60, 1)).astype(np.float32)))
    queries = [(0, np.zeros(4, np.float32)), (1, np.float32([9, 0, -3, 1])), (2, np.float32([-0.1, 0.2, 0, 0]))]
    q, x = frames(spark, queries, items)
    assert got(knn_exact(q, x, 7, 9, 11, 2)) == brute(queries, items, 7)
    assert len(got(knn_exact(q, x, 500, 9, 11, 2))) == 180
    assert got(knn_exact(q, x.filter("false"), 3)) == []
    assert got(knn_exact(q, x, 0)) == []


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(5)
    items, queries = list(enumerate(unit(rng, 80, 8))), list(enumerate(unit(rng, 6, 8)))
    runs = [got(knn_exact(*frames(spark, queries, items, parts), 4)) for parts in (1, 8)]
    assert runs[0] == runs[1]


def test_ann_reaches_recall_by_default(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (1600, 16)))]  # no clusters
    x = spark.createDataFrame(rows, "item_id long, vec array<float>")
    q = spark.createDataFrame(rows[::4], "query_id long, vec array<float>")
    recall = recall_at_k(knn_ann(q, x, 10), knn_exact(q, x, 10)).agg(F.avg("recall")).first()[0]
    eight = recall_at_k(knn_ann(q, x, 10, nprobe=8), knn_exact(q, x, 10)).agg(F.avg("recall")).first()[0]
    assert eight < 0.9 <= recall
    assert knn_ann(q.filter("false"), x, 10).count() == 0 and knn_ann(q, x.filter("false"), 10).count() == 0


def test_ann_recall(spark):
    rng = np.random.default_rng(11)
    items, queries = list(enumerate(unit(rng, 400, 8))), list(enumerate(unit(rng, 30, 8)))
    q, x = frames(spark, queries, items)
    exact = knn_exact(q, x, 5)
    few = recall_at_k(knn_ann(q, x, 5, nprobe=2), exact).agg(F.avg("recall")).first()[0]
    many = recall_at_k(knn_ann(q, x, 5, nprobe=12), exact).agg(F.avg("recall")).first()[0]
    everything = recall_at_k(knn_ann(q, x, 5, nprobe=1000), exact).agg(F.avg("recall")).first()[0]
    assert few < many and many > 0.9 and everything == 1.0


def test_hashing_encoder(spark):
    df = spark.createDataFrame([(1, "python spark"), (2, "Spark,  Python"), (3, "cooking"), (4, "")], "i int, t string")
    vectors = {r.i: np.array(r.v) for r in hashing_encoder(64)(df, "t", "v").collect()}
    assert np.allclose(vectors[1], vectors[2]) and abs(np.linalg.norm(vectors[1]) - 1) < 1e-6
    assert not vectors[4].any() and len(vectors[4]) == 64


def test_model_encoder_normalises(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("a  b",), ("",)], "t string")
    vectors = [r.v for r in model_encoder(load)(df, "t", "v").collect()]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in vectors)
    assert abs(vectors[0][0] / vectors[0][1] - 3) < 1e-5  # squeezed before encoding


def test_incremental_encoding(spark):
    first = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "i int, t string")
    _, stored = encode_incremental(first, "t", None, hashing_encoder(16), "m")
    more = spark.createDataFrame([(3, "alpha  beta"), (4, "delta"), (5, "delta")], "i int, t string")
    full, fresh = encode_incremental(more, "t", stored, hashing_encoder(16), "m")
    assert fresh.count() == 1 and sorted(r.i for r in full.collect()) == [3, 4, 5]
    _, other = encode_incremental(more, "t", stored, hashing_encoder(16), "another model")
    assert other.count() == 2


def test_check_vectors(spark):
    good = spark.createDataFrame([(1, [1.0]), (2, [0.0])], "item_id long, vec array<float>")
    check_vectors(good, "item_id", "vec", 1)
    with pytest.raises(ValueError):
        check_vectors(good.union(good), "item_id", "vec")
    with pytest.raises(ValueError):
        check_vectors(good, "item_id", "vec", 2)


def test_small_cells_share_blocks():
    first, many = pack_cells(np.array([3, 0, 4, 25, 5, 1, 10]), 10)
    assert many.tolist() == [1, 1, 1, 3, 1, 1, 1]
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 5]  # 3 + 0 + 4, then 25 in three of their own, then 5 + 1, 10
    first, many = pack_cells(np.full(4096, 2), 1000)
    assert int((first + many).max()) == 9  # not one tile for each cell


def test_a_tile_of_several_cells_is_searched_by_cell():
    rng = np.random.default_rng(4)
    asks, items, cells = rng.normal(size=(30, 4)), rng.normal(size=(200, 4)), rng.integers(0, 6, 200)
    ids, visit = rng.permutation(200), rng.random((30, 6)) < 0.5
    got = best_of_cells(np.arange(30), asks, visit, ids, items, cells, 7).to_pylist()
    want = []
    for q in range(30):
        seen = [(-round(float(asks[q] @ items[i]), 6), int(ids[i])) for i in range(200) if visit[q, cells[i]]]
        want += [(q, i, -s) for s, i in sorted(seen)[:7]]
    assert [(r["query_id"], r["item_id"]) for r in got] == [w[:2] for w in want]
    assert np.allclose([r["score"] for r in got], [w[2] for w in want], atol=1e-9)
    # scores that are equal after rounding go to the lower id, also where they differ before
    tile = best_of_tile(np.array([0]), np.array([[1.0]]), np.array([2, 1, 3]), np.array([[0.50000002], [0.5], [0.1]]), 1)
    assert tile.column("item_id").to_pylist() == [1]


def test_hits_stay_bounded_and_exact_over_many_blocks(spark, monkeypatch):
    """A chunk gives ``k`` hits a query and band, whatever the number of blocks its items stream past in."""
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", 600)
    monkeypatch.setattr(knn, "HITS_AT_ONCE", 600)
    monkeypatch.setattr(knn, "ITEMS_AT_ONCE", 16)
    rng = np.random.default_rng(9)
    vectors = unit(rng, 400, 8)
    vectors[100:200] = vectors[0]  # copies: ties go to the lower id, in whatever block they lie
    seen = []
    ranked = knn.top_n
    monkeypatch.setattr(knn, "top_n", lambda df, *a: seen.append(df) or ranked(df, *a))
    q, x = frames(spark, list(enumerate(vectors[:40])), list(enumerate(vectors)))
    found = got(knn_exact(q, x, 6, None, 5, 40))
    assert found == brute(list(enumerate(vectors[:40])), list(enumerate(vectors)), 6)
    bands = 2 * spark.sparkContext.defaultParallelism
    assert seen[0].count() <= 40 * 6 * bands < 40 * 6 * 80


def test_single_precision_only_leaves_out_what_is_not_best():
    rng = np.random.default_rng(12)
    asks, items = rng.normal(size=(20, 16)) * 1e4, rng.normal(size=(3000, 16)) * 1e4
    items[1500:] = items[:1500] * (1 + 1e-9)  # nearer than single precision tells
    got = best_of_tile(np.arange(20), asks, np.arange(3000), items, 5).to_pylist()
    want = [(q, int(i)) for q in range(20) for i in np.lexsort((np.arange(3000), -np.round(items @ asks[q], 6)))[:5]]
    assert [(r["query_id"], r["item_id"]) for r in got] == want


def test_unlike_labels_are_searched_beyond_the_first_hits(spark):
    """Most of the best hits of some queries are of the label they leave out; ids repeat, labels are null or differ."""
    rng = np.random.default_rng(3)
    vecs, asks = unit(rng, 90, 8), unit(rng, 12, 8)
    items = [(i, v, int(i % 4)) for i, v in enumerate(vecs)] + [(i, vecs[i], 1) for i in (3, 3, 40)]
    items += [(200 + i, asks[0] + np.float32(i / 1000), 2) for i in range(20)] + [(300, asks[0], None), (301, asks[1], None)]
    queries = [(q, v, (2, 0, 1, None)[q % 4]) for q, v in enumerate(asks)] + [(5, asks[5], 3), (6, asks[6], 1), (7, asks[7], 0)]
    want = {}
    for q, vec, unlike in queries:
        for i, v, label in items:
            if None not in (unlike, label) and label != unlike:
                want.setdefault(q, []).append((-round(float(np.dot(np.float64(vec), np.float64(v))), 6) + 0.0, i))
    want = sorted((q, i, -s + 0.0, rank) for q, found in want.items() for rank, (s, i) in enumerate(sorted(found)[:6], 1))
    asked = spark.createDataFrame([(q, v.tolist(), u) for q, v, u in queries], "query_id long, vec array<float>, unlike int")
    offered = spark.createDataFrame([(i, v.tolist(), n) for i, v, n in items], "item_id long, vec array<float>, label int")
    for depth in (6, 9, 1000):
        assert got(knn_exact_unlike(asked, offered, 6, knn_exact(asked, offered, depth), depth)) == want
