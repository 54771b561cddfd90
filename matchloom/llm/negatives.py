"""Hard-negative mining with scores from a residue-number-system matrix product.

Vectors are whole numbers (``floor(256 * x)``). The inner products of a block of anchors with a block of rows are
computed modulo several primes below 256: residues are taken around zero, so a float32 product of residue
matrices adds whole numbers below 2^24 and is exact (wide vectors are multiplied in strips). As many primes
are used as their product needs to pass twice the largest possible score, the product of the two blocks' largest
norms. Mixed-radix Chinese remaindering then gives the signed scores back, exactly.

1. Positives: an anchor's first rows of its own label. Every (anchor chunk, row block) tile hands on its best
   few per anchor, a last ranking merges them.
2. Windows: a positive with score s allows negatives from ``low`` to ``high`` percent of s. The tiles are computed
   again, now with the windows known; each hands on the best few rows of other labels inside each window,
   and a last ranking merges them.

The anchors are a stated query set against all rows, in tiles of bounded size; rows are dealt by hash, so a label
that a third of all rows share makes no large group. No scores are kept.

Edge cases: rows with a null id, label or vector, or a null, NaN or infinite component take no part. Vectors of
different widths don't meet. A row with the anchor's id is none of its candidates; repeated rows are candidates
of their own, and an anchor's repeated rows are one anchor each. Ties go to the smaller id. A positive with a
negative score has an empty window. Scores beyond 64 bits are cut off at the ends of that range, components
are so by the cast to long; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from matchloom.llm.common import stored

ROWS_PER_BLOCK, ANCHORS_PER_CHUNK = 8192, 8192
_SLAB = 256  # anchors of a tile that are multiplied at a time
_EXACT = 1 << 24  # float32 holds all whole numbers up to this

#: primes below 256, the largest first
PRIMES = [p for p in range(255, 2, -1) if all(p % d for d in range(2, 16))]


def _norm_bound(rows: np.ndarray) -> int:
    """A whole number that no row's Euclidean norm passes."""
    if not rows.size:
        return 0
    most = max(int(rows.max()), -int(rows.min()))
    if most < 1 << 26 and rows.shape[1] < 1 << 10:
        return isqrt(int((rows * rows).sum(axis=1).max())) + 1
    return most * (isqrt(rows.shape[1]) + 1)


def _primes_for(bound: int) -> list[int]:
    """Enough primes that all scores from ``-bound`` to ``bound`` have residues of their own."""
    product, n = 1, 0
    while product <= 2 * bound + 1:
        if n == len(PRIMES):
            raise ValueError(f"scores up to {bound} need more primes than there are")
        product *= PRIMES[n]
        n += 1
    return PRIMES[: max(1, n)]


def _residues(rows: np.ndarray, prime: int) -> np.ndarray:
    """Residues around zero as float32."""
    rest = rows % prime
    return (rest - prime * (rest > prime // 2)).astype(np.float32)


def _product_mod(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """``a @ b.T`` modulo ``prime``, in float32 and exact; ``a`` and ``b`` are residues around zero."""
    strip = max(1, _EXACT // (prime // 2) ** 2)
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], strip):
        out += (a[:, at : at + strip] @ b[:, at : at + strip].T).astype(np.int64)
    return out % prime


class ResidueRows:
    """Rows of whole numbers with their residues, prime by prime as they are asked for."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.bound = rows, _norm_bound(rows)
        self._known: dict[int, np.ndarray] = {}

    def residues(self, prime: int) -> np.ndarray:
        if prime not in self._known:
            self._known[prime] = _residues(self.rows, prime)
        return self._known[prime]


def scores(anchors: ResidueRows, rows: ResidueRows, part: slice = slice(None)) -> np.ndarray:
    """Exact inner products of the anchors of ``part`` with all rows; Python integers where 64 bits are too few."""
    primes = _primes_for(anchors.bound * rows.bound)
    product = prod(primes)
    wide = product >= 1 << 62
    digits: list[np.ndarray] = []  # mixed-radix digits: value = d0 + p0 (d1 + p1 (d2 + ...))
    for i, prime in enumerate(primes):
        digit = _product_mod(anchors.residues(prime)[part], rows.residues(prime), prime)
        for j in range(i):
            digit = (digit - digits[j]) * pow(primes[j], -1, prime) % prime
        digits.append(digit)
    value = digits[-1].astype(object) if wide else digits[-1]
    for prime, digit in zip(primes[-2::-1], digits[-2::-1]):
        value = value * prime + digit
    return np.where(value > product // 2, value - product, value)


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, vec array<long>)`` of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("vec"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0), np.int64)


class _Tile:
    """A chunk of anchors and a block of rows, the rows by ascending id."""

    def __init__(self, left: pa.Table, right: pa.Table):
        right = right.sort_by("vec_id")
        self.anchors, self.rows = ResidueRows(_matrix(left.column("vec"))), ResidueRows(_matrix(right.column("vec")))
        self.ids = right.column("vec_id").to_numpy()
        # labels of both sides as numbers
        names = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks]).combine_chunks().dictionary_encode()
        of = names.indices.to_numpy(zero_copy_only=False)
        self.anchor_label, self.label = of[: left.num_rows], of[left.num_rows :]
        self.anchor_id = left.column("anchor_id").to_numpy()

    def __iter__(self):
        """``(anchor's place, its scores, whether each row has its label, whether it is another row)``"""
        for at in range(0, len(self.anchor_id), _SLAB):
            found = scores(self.anchors, self.rows, slice(at, at + _SLAB))
            for i, row in enumerate(found, at):
                yield i, row, self.label == self.anchor_label[i], self.ids != self.anchor_id[i]


def _leading(found: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``places`` with the highest scores; equal scores in the order of ``places``."""
    values = found[places]
    if len(places) > k:
        limit = np.partition(values, len(values) - k)[len(values) - k]
        places = places[values >= limit]
        values = found[places]
    return places[np.argsort(-values, kind="stable")][:k]


def _long(values) -> list[int]:
    return [min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in values]


_POSITIVES = pa.schema([("anchor", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NEGATIVES = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _best_positives(k: int):
    def run(key, left, right):
        out = {name: [] for name in _POSITIVES.names}
        if left.num_rows and right.num_rows:
            tile, anchors = _Tile(left, right), left.column("anchor").to_pylist()
            for i, found, same, other in tile:
                best = _leading(found, np.flatnonzero(same & other), k)
                out["anchor"] += [anchors[i]] * len(best)
                out["vec_id"] += tile.ids[best].tolist()
                out["score"] += _long(found[best])
        return pa.Table.from_pydict(out, _POSITIVES)

    return run


def _best_negatives(k: int, low: int, high: int):
    def run(key, left, right):
        out = {name: [] for name in _NEGATIVES.names}
        if left.num_rows and right.num_rows:
            tile, anchors, windows = _Tile(left, right), left.column("anchor").to_pylist(), left.column("windows").to_pylist()
            for i, found, same, _ in tile:
                places = np.flatnonzero(~same)
                places = places[np.argsort(-found[places], kind="stable")]
                falling = -found[places]
                for window in windows[i]:
                    # low * s <= 100 * score <= high * s, in whole numbers
                    most, least = high * window["score"] // 100, -(-low * window["score"] // 100)
                    begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    best = places[begin : min(end, begin + k)]
                    out["anchor"] += [anchors[i]] * len(best)
                    out["place"] += [window["place"]] * len(best)
                    out["vec_id"] += tile.ids[best].tolist()
                    out["score"] += _long(found[best])
        return pa.Table.from_pydict(out, _NEGATIVES)

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, sizes: dict[int, tuple[int, int]]) -> tuple:
    """Both sides grouped by tile. ``sizes`` has by vector width the numbers of anchor chunks and row blocks."""
    by_width = F.create_map(*[F.lit(x) for w, n in sizes.items() for x in (w, F.struct(F.lit(n[0]).alias("chunks"), F.lit(n[1]).alias("blocks")))])
    sized = lambda df: df.withColumn("width", F.size("vec")).withColumn("of", by_width[F.col("width")])
    spread = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    left = sized(anchors).withColumn("chunk", spread("anchor", F.col("of.chunks")))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of.blocks") - 1))).drop("of")
    right = sized(rows).withColumn("block", spread("row", F.col("of.blocks")))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("of.chunks") - 1))).drop("of", "row")
    where = ["width", "chunk", "block"]
    return left.groupBy(*where), right.groupBy(*where)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, label, vec
    array<long>)``; anchors are the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "label", "vec", F.monotonically_increasing_id().alias("row")), "rows")
    is_anchor = F.col("vec_id") % every == 0
    anchors = rows.filter(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec")
    anchors = stored(anchors, "anchors")
    counts = rows.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("asked")).collect()
    sizes = {r.width: (-(-r.asked // ANCHORS_PER_CHUNK), -(-r.n // ROWS_PER_BLOCK)) for r in counts if r.asked}
    ddl = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes:
        return spark.createDataFrame([], ddl)
    rows = rows.filter(F.size("vec").isin(list(sizes)))

    left, right = _tiles(anchors, rows, sizes)
    found = left.cogroup(right).applyInArrow(_best_positives(positives), "anchor long, vec_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    found = stored(found, "positives")

    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("windows"))  # few each
    left, right = _tiles(stored(anchors.join(windows, "anchor"), "windows"), rows, sizes)
    negative = left.cogroup(right).applyInArrow(_best_negatives(negatives, low, high), "anchor long, place int, vec_id long, score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id")
    negative = negative.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    positive = found.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = negative.join(positive, ["anchor", "place"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
