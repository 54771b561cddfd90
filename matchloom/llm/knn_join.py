"""Exact top-k search by a Voronoi kNN join on inner products of whole-number vectors.

Components x become ``floor(256 * x)``. Pivots are vectors of a bounded sample. Every vector belongs to the
cell of its nearest pivot; per cell a summary keeps the number of vectors and the largest distance from the
pivot. For a query q and a cell with pivot p, radius r and a member x,

    |q.x - q.p| = |q.(x - p)| <= |q| r,

so the summaries alone give, per query, a score that its k-th neighbour reaches at least (enough cells hold
k vectors above it), and a cell whose best possible score is below that is not visited. Queries of one cell
share the list of cells that any of them needs, and meet no other; a cell's vectors go only to the queries whose lists
name it. Small query cells are put together for scheduling, each with its own list; more than ``CHUNK_ROWS`` queries
are cut into chunks, each cell into as many blocks as its own size asks for. Each (chunk, block) is solved by itself
and hands on its best k per query, and a last ranking merges them.

Vectors of different widths are searched within their width. A vector that is null or holds a null, NaN or
infinite component takes no part; a null id neither. Ties in score go to the smaller id; repeated rows are
separate candidates, but a query's own id is no candidate. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.llm.common import hash_sample, stored

MIN_PIVOTS, MAX_PIVOTS = 64, 512
BLOCK_ROWS = 8192
CHUNK_ROWS = 8192
_ROWS = 256
SUMMARY_BYTES = 64 << 20
_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, vec array<long>)`` of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(fine).select("vec_id", whole.alias("vec"))


def _matrix(column) -> np.ndarray:
    """Rows of equal width as a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in whole numbers: by floating point where that is exact, else by integers."""
    width = max(1, a.shape[1])
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2**52 else a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``k`` best scores, ties to smaller ids, without its own id."""
    order = np.argsort(ids, kind="stable")
    keep_row, keep_column = [], []
    for row in range(len(scores)):
        ranked = scores[row, order]
        allowed = np.flatnonzero(ids[order] != own[row])
        if len(allowed) > k:
            limit = np.partition(ranked[allowed], len(allowed) - k)[len(allowed) - k]
            allowed = allowed[ranked[allowed] >= limit]
        allowed = allowed[np.argsort(-ranked[allowed], kind="stable")][:k]
        keep_row.append(np.full(len(allowed), row))
        keep_column.append(order[allowed])
    return np.concatenate(keep_row).astype(int), np.concatenate(keep_column).astype(int)


def _with_cell(pivots: np.ndarray):
    """Adds the nearest pivot and the distance to it; work per batch is rows x pivots x width."""
    points = pivots.astype(float)
    norms = (points**2).sum(axis=1)

    def run(source):
        for batch in source:
            rows = _matrix(batch.column("vec")).astype(float)
            cell = (norms[None, :] - 2 * (rows @ points.T)).argmin(axis=1)
            distance = np.sqrt(((rows - points[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], [*batch.schema.names, "cell", "distance"]
            )

    return run


def _needed(pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, k: int):
    """Cells that each query has to visit, from the summaries only."""
    points = pivots.astype(float)
    norms = np.sqrt((points**2).sum(axis=1))
    schema = pa.schema([("group", pa.int32()), ("cell", pa.int32())])

    def run(source):
        for batch in source:
            rows = _matrix(batch.column("vec")).astype(float)
            centre = rows @ points.T
            reach = np.sqrt((rows**2).sum(axis=1))[:, None] * radii[None, :]
            slack = 1e-9 * (1 + reach + np.sqrt((rows**2).sum(axis=1))[:, None] * norms[None, :])
            low, high = centre - reach - slack, centre + reach + slack
            order = np.argsort(-low, axis=1)
            # one vector more than k: the query itself may be among them
            enough = (np.cumsum(counts[order], axis=1) > k).argmax(axis=1)
            kth = np.take_along_axis(low, order, axis=1)[np.arange(len(rows)), enough]
            kth[counts.sum() <= k] = -np.inf
            visit = (high >= kth[:, None]) & (counts > 0)[None, :]
            group, cell = np.nonzero(visit)
            pairs = np.unique(np.stack([batch.column("cell").to_numpy()[group], cell], axis=1), axis=0)  # cell: of queries
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))], schema=schema)

    return run


def _solve(k: int):
    def run(key, left, right):
        queries, data = left.combine_chunks(), right.combine_chunks()
        if not queries.num_rows or not data.num_rows:
            return _RESULT.empty_table()
        own, ids = queries.column("query_id").to_numpy(), data.column("vec_id").to_numpy()
        asked, members = _matrix(queries.column("vec")), _matrix(data.column("vec"))
        out = []
        for at in range(0, len(own), _ROWS):
            mine = own[at : at + _ROWS]
            scores = products(asked[at : at + _ROWS], members)
            row, column = best(scores, ids, mine, k)
            out.append(pa.table([pa.array(mine[row]), pa.array(ids[column]), pa.array(scores[row, column])], schema=_RESULT))
        return pa.concat_tables(out)

    return run


def _bundles(sizes: dict[int, int]) -> dict[int, int]:
    """Query cells put together, in order, until ``CHUNK_ROWS`` queries are reached: cell -> bundle."""
    out, bundle, held = {}, 0, 0
    for cell in sorted(sizes):
        if held and held + sizes[cell] > CHUNK_ROWS:
            bundle, held = bundle + 1, 0
        out[cell] = bundle
        held += sizes[cell]
    return out


def _by_number(values: dict[int, int], number: str) -> Column:
    """A small table of numbers, one per pivot at most, as an expression."""
    return F.element_at(F.create_map(*[F.lit(int(x)) for pair in values.items() for x in pair]), F.col(number))


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """The ``k`` vectors of largest inner product for every query: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id, vec array<long>`` and one width per call; use ``top_k`` for raw tables. ``pivots``: by
    default the square root of the vectors' number, from ``MIN_PIVOTS`` to ``MAX_PIVOTS`` and within ``SUMMARY_BYTES``.
    """
    spark = vectors.sparkSession
    first, total = vectors.select("vec").first(), vectors.count()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bytes_each = 8 * max(1, len(first.vec))
    if pivots is None:
        pivots = max(1, min(max(MIN_PIVOTS, isqrt(total)), MAX_PIVOTS, SUMMARY_BYTES // bytes_each))
    elif pivots * bytes_each > SUMMARY_BYTES:
        raise ValueError(f"{pivots} pivots of {bytes_each} bytes exceed {SUMMARY_BYTES} bytes: use fewer")
    points = np.array([r.vec for r in hash_sample(vectors, ["vec_id"], pivots, total).select("vec").collect()], np.int64)

    ddl = "vec_id long, vec array<long>, cell int, distance double"
    celled = stored(vectors.select("vec_id", "vec").mapInArrow(_with_cell(points), ddl), "cells")
    asked = stored(queries.select("vec_id", "vec").mapInArrow(_with_cell(points), ddl), "queries")
    counts, radii = np.zeros(len(points), np.int64), np.zeros(len(points))
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect():
        counts[r.cell], radii[r.cell] = r.n, r.r
    sizes = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()} or {0: 0}
    bundle_of, held = _bundles(sizes), {}
    for cell, bundle in bundle_of.items():
        held[bundle] = held.get(bundle, 0) + sizes[cell]
    chunks = {bundle: max(1, -(-n // CHUNK_ROWS)) for bundle, n in held.items()}
    blocks = {cell: n // BLOCK_ROWS + 1 for cell, n in enumerate(counts.tolist())}

    visits = stored(visited(asked, points, counts, radii, k), "visits")
    visits = visits.withColumn("bundle", _by_number(bundle_of, "group")).withColumn("chunks", _by_number(chunks, "bundle"))
    blocked = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")
    needed = visits.select(*[F.col(c).alias(c) for c in ("bundle", "chunks", "cell")]).distinct()  # at most pivots^2 rows
    data = celled.withColumn("blocks", _by_number(blocks, "cell")).withColumn("block", blocked).join(F.broadcast(needed), "cell")
    data = data.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # a query meets the blocks of the cells on its own cell's list
    placed = asked.withColumnRenamed("cell", "group").join(F.broadcast(visits), "group")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("chunks")).cast("int"))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), _by_number(blocks, "cell") - 1)))
    where = ["bundle", "chunk", "cell", "block"]
    left = placed.select(*where, F.col("vec_id").alias("query_id"), "vec")
    found = left.groupBy(*where).cogroup(data.select(*where, "vec_id", "vec").groupBy(*where)).applyInArrow(
        _solve(k), "query_id long, vec_id long, score long"
    )
    return ranked(found, k)


def visited(asked: DataFrame, points: np.ndarray, counts: np.ndarray, radii: np.ndarray, k: int) -> DataFrame:
    """``(group, cell)``: the cells that the queries of a cell (``group``) have to visit, at most pivots^2 rows."""
    return asked.mapInArrow(_needed(points, counts, radii, k), "group int, cell int").distinct()


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query's candidates."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(table: DataFrame, k: int = 5, every: int = 50, pivots: int | None = None) -> DataFrame:
    """The search over ``table(vec_id, embedding)`` with the rows whose id ``every`` divides as queries."""
    vectors = stored(quantized(table), "vectors")
    widths = [r.width for r in vectors.select(F.size("vec").alias("width")).distinct().collect()]
    found = [
        knn_join(same.filter(F.col("vec_id") % every == 0), same, k, pivots)
        for same in (vectors.filter(F.size("vec") == width) for width in sorted(widths) or [0])
    ]
    return reduce(DataFrame.unionByName, found)
