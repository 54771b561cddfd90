"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

Two documents are linked when their sets of word shingles have a similarity of at least ``percent``;
groups are the connected components of the links.

1. One pass over the texts makes a sketch per document: the size of its set, a digest of the set, a
   one-permutation signature cut into bands, and a 512-bit parity map of the set. Documents with equal
   sets form one class and go on as one.
2. Buckets hold the classes that share a band. Each bucket gives a star: edges from a centre to its
   members, so a bucket of g classes makes g - 1 pairs.
3. Edges are confirmed on the full sets. The parity maps first rule out edges that cannot hold: the
   number of bits in which two maps differ is never more than the number of shingles in which the sets
   differ, so nothing that links is lost.
4. A star can miss a link between two members of which one is not linked to the centre. The members of buckets
   that still hold several components are joined once more, exactly, on the rarest shingles of their sets: of two sets
   that link, each has one of the other's among its ``n - ceil(s n) + 1`` rarest, for any order of shingles that is the
   same for all. The order comes from counts in a bounded sample (``ORDER_DOCS`` sets, the ``ORDER_SHINGLES`` most
   frequent shingles), so that boilerplate comes last and texts that share only that never meet. Where a shingle's
   group holds several components, its members outside its largest component meet the members of other components,
   in salted pieces and behind the bound of 3; what passes is confirmed as before.
   After that every pair which shares a bucket is either in one component or known not to link.

With 24 bands of 5 bins a pair at similarity 0.85 shares no bucket with a probability below 1e-6.

Edge cases: a null, empty or blank text has the empty set, links with nothing and is its own component;
fewer words than a shingle are one shingle. Rows with one doc_id are one document, linked as any of its
texts is. A null doc_id takes the component of the rows with an equal set, if they have ids, else none.
An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm.common import batches, bound_batches, hash_sample, small_batches, stored
from matchloom.llm.components import components
from matchloom.llm.shingles import OnePermutation, mix, overlap, shingle_set, similar

MAP_WORDS = 8
PIECE = 2048
MIN_BITMAP_WORDS, MAX_BITMAP_WORDS = 1 << 12, 1 << 22  # 32 KB to 32 MB of bits
ORDER_DOCS, ORDER_SHINGLES = 20_000, 1 << 18
_MAP = [f"m{i}" for i in range(MAP_WORDS)]
_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))]
    + [(m, pa.int64()) for m in _MAP]
)
_SKETCH_DDL = "doc_id long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{m} long" for m in _MAP)


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of the set's hashes end in i."""
    bits = np.bincount((hashes & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sketches(bands: int, rows: int, shingle: int):
    def run(source):
        minhash = OnePermutation(bands, rows)
        for batch in small_batches(source, "text"):
            out = {name: [] for name in _SKETCH.names}
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = shingle_set(text, shingle)
                out["doc_id"].append(doc_id)
                out["n_shingles"].append(len(hashes))
                if len(hashes):
                    out["set_key"].append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    out["bands"].append(minhash.band_keys(minhash.signature(hashes)).view(np.int64))
                    words = parity_map(hashes).tolist()
                else:
                    out["set_key"].append(None)
                    out["bands"].append(None)
                    words = [None] * MAP_WORDS
                for name, word in zip(_MAP, words):
                    out[name].append(word)
            yield batches(out, _SKETCH)

    return run


def sketch(docs: DataFrame, bands: int = 24, rows: int = 5, shingle: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: set size, set digest, band keys, parity map."""
    return bound_batches(docs).select("doc_id", "text").mapInArrow(_sketches(bands, rows, shingle), _SKETCH_DDL)


def _possible(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id falls on a bit that some member's id has set.

    The bitmap has 64 bits a member and at most ``MAX_BITMAP_WORDS`` words, so it can be broadcast, and texts of
    other documents are hardly ever shuffled. It only lets some rows through in vain; an exact join follows.
    """
    words = min(MAX_BITMAP_WORDS, max(MIN_BITMAP_WORDS, 1 << members.count().bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    at = members.select(bit("node").alias("bit"))
    bitmap = at.groupBy(F.expr("bit div 64").alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("__mask")
    )
    placed = docs.withColumn("__bit", bit("doc_id")).withColumn("__word", F.expr("__bit div 64"))
    found = placed.join(F.broadcast(bitmap), "__word").filter("shiftright(__mask, cast(__bit % 64 as int)) & 1 = 1")
    return found.select("doc_id", "text")


def _sets(shingle: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])

    def run(source):
        for batch in small_batches(source, "text"):
            ids, texts = (c.to_pylist() for c in batch.columns)
            found = [shingle_set(t, shingle) for t in texts]
            yield batches({"node": ids, "n": [len(x) for x in found], "hashes": [x.tobytes() for x in found]}, schema)

    return run


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        for batch in small_batches(source, "left"):
            out = {"a": [], "b": []}
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                if similar(len(x), len(y), overlap(x, y), percent):
                    out["a"].append(a)
                    out["b"].append(b)
            yield batches(out, schema)

    return run


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    pairs = edges.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return pairs.mapInArrow(_confirm(percent), "a long, b long").distinct()


def can_link(left: str, right: str, percent: int) -> Column:
    """False only where two sets are certainly too different: see the module's text, point 3."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{left}.{m}").bitwiseXOR(F.col(f"{right}.{m}"))) for m in _MAP])
    n_left, n_right = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    least = F.greatest(differ.cast("long"), F.abs(n_left - n_right))
    return (100 + percent) * least <= (100 - percent) * (n_left + n_right)


def _shingle_order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that are frequent in a sample of ``sets``."""

    def run(source):
        for batch in small_batches(source, "hashes"):
            found = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
            hashes, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": hashes.view(np.int64), "n": n})

    sample = hash_sample(sets.select("node", "hashes"), ["node"], ORDER_DOCS).select("hashes")
    counted = sample.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1")
    top = counted.orderBy(F.desc("n"), "hash").limit(ORDER_SHINGLES).toArrow()
    hashes, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _rarest(broadcast, percent: int):
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64())])

    def run(source):
        known, counts = broadcast.value
        for batch in small_batches(source, "hashes"):
            nodes, keys = [], []
            for node, data in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = np.frombuffer(data, np.uint64)
                seen = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    seen = np.where(known[at] == hashes, counts[at], 0)
                first = len(hashes) - -(-percent * len(hashes) // 100) + 1
                keys.append(hashes[np.lexsort((mix(hashes), seen))[:first]].view(np.int64))
                nodes.append(np.full(len(keys[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(keys))], schema=schema)

    return run


def _rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(node, component, n_shingles, *maps)`` of different components that may link, all that
    do among them."""
    sets = stored(sets.join(nodes.select("node"), "node", "left_semi").select("node", "hashes"), "unsettled_sets")
    order = sets.sparkSession.sparkContext.broadcast(_shingle_order(sets))
    rare = sets.mapInArrow(_rarest(order, percent), "node long, key long")
    placed = rare.join(nodes.select("node", "component"), "node")
    main = (
        placed.groupBy("key", "component").count().groupBy("key")
        .agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("count").alias("members"))
        .filter("kinds > 1")
    )
    open_ = stored(rare.join(main, "key").join(nodes, "node"), "rare")
    open_ = open_.withColumn("pieces", F.floor(F.col("members") / PIECE).cast("int") + 1)
    few = open_.filter("component <> main").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    all_ = open_.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    x, y = few.alias("x"), all_.alias("y")
    return x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.piece") == F.col("y.piece"))
        & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        & can_link("x", "y", percent),
    ).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def near_groups(
    docs: DataFrame, percent: int = 85, shingle: int = 5, bands: int = 24, rows: int = 5
) -> tuple[DataFrame, DataFrame]:
    """``(documents, links)``: one row ``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``, and
    the confirmed links between class representatives that hold the components together."""
    docs = docs.select("doc_id", "text")
    sketches = stored(sketch(docs, bands, rows, shingle), "sketches")
    # a class is represented by its smallest doc_id
    classes = (
        sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", *_MAP), "doc_id").alias("c"))
        .select("set_key", F.col("c.doc_id").alias("node"), "c.n_shingles", "c.bands", *[f"c.{m}" for m in _MAP])
    )
    classes = stored(classes, "classes")
    in_bands = classes.select("node", F.explode("bands").alias("key"))
    centres = (
        in_bands.groupBy("key")
        .agg(F.min_by("node", F.xxhash64("node", "key")).alias("centre"), F.count("*").alias("members"))
        .filter("members > 1")
    )
    buckets = stored(in_bands.join(centres, "key"), "buckets")
    members = stored(
        classes.select("node", "n_shingles", *_MAP).join(buckets.select("node").distinct(), "node", "left_semi"), "members"
    )
    # full sets, only of documents that share a bucket with another
    sets = _possible(docs, members).mapInArrow(_sets(shingle), "node long, n long, hashes binary")
    sets = stored(sets.filter("n > 0").join(members.select("node"), "node", "left_semi"), "sets")

    star = buckets.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    star = (
        star.join(members.alias("x"), F.col("a") == F.col("x.node"))
        .join(members.alias("y"), F.col("b") == F.col("y.node"))
        .filter(can_link("x", "y", percent))
        .select("a", "b")
        .distinct()
    )
    links = stored(confirmed(star, sets, percent), "links")
    placed = components(links)

    # buckets that still hold several components
    named = F.coalesce("component", "node").alias("component")
    in_buckets = buckets.select("key", "node").join(placed, "node", "left").select("key", "node", named)
    several = in_buckets.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    unsettled = stored(in_buckets.join(several.select("key"), "key", "left_semi").select("node", "component").distinct(), "unsettled")
    more = _rare_pairs(unsettled.join(members, "node"), sets, percent)
    late = stored(confirmed(more.distinct(), sets, percent), "links")
    placed = _joined_up(placed, late)
    links = links.unionByName(late)
    by_class = classes.select("set_key", "node").join(placed, "node", "left").select("set_key", named)
    result = sketches.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    result = result.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
    )
    return result, links


def _joined_up(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component)`` after further ``links(a, b)``: components are merged, nodes not visited again."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        of = placed.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        ends = ends.join(of, end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    merged = components(ends, "a_in", "b_in").select(F.col("node").alias("component"), F.col("component").alias("into"))
    # a merged name may be a node that had no link before
    known = placed.unionByName(merged.select(F.col("component").alias("node"), "component")).distinct()
    moved = known.join(merged, "component", "left")
    return moved.select("node", F.coalesce("into", "component").alias("component")).distinct()


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    return near_groups(docs, **options)[0]


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the documents that ``near_dedup`` keeps. Rows without a doc_id stay:
    they can't be told apart, and none of them is ever another's representative."""
    gone = near_dedup(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
