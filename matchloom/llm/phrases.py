"""Phrase collocations from a weighted de Bruijn graph of word grams.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``.
With phrases of up to ``m`` words, an edge is an ``m``-gram and joins the two nodes, ``(m-1)``-grams, that it
begins and ends with. Every language has a graph of its own.

1. *Nodes worth keeping.* No gram that holds a pair of words seen fewer than ``least`` times can be a candidate. A
   first pass counts hashes of words and pairs; the frequent ones set bits in a bitmap of bounded size. A
   bit set in vain only keeps a gram that the counts drop later; no frequent gram is ever lost.
2. *Edges.* In a second pass each word occurrence hands on exactly one gram, the longest that begins there:
   an edge, or a shorter gram where the piece ends or the next pair can't be frequent (the corrections). Equal
   grams are added up in each batch, in each task, and then after one shuffle.
3. *Unary paths.* Edges of weight ``least`` or more are compacted: a node with one edge in and one edge out is
   no branching, so its edges lie on one path. Paths are found by pointer doubling over edge numbers (as many
   rounds as the logarithm of the longest path), cycles are opened at their smallest edge.
4. *Shorter counts.* A node inside a path has the weight of its one edge out, other nodes the sum over theirs;
   lighter edges and corrections are added: that is the count of the ``(m-1)``-gram. The shorter counts follow
   in the same way, each gram's count flows to the gram without its last word. Nothing is counted twice.
5. Candidates are scored by their weakest cut and dropped inside longer ones that carry half of their count.

Edge cases: a null text is empty, a null language is ``und`` (one with rows of that name); empty texts and
pieces without words give nothing; repeated rows count each; equal scores go by count, then by the phrase's
bytes; texts of any length are read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.llm.common import bound_batches, stored
from matchloom.llm.shingles import mix

BITS_PER_GRAM, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 28
BATCH_BYTES = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_GRAMS = pa.schema([("lang", pa.string()), ("size", pa.int8()), ("gram", pa.string()), ("n", pa.int64())])


class Words:
    """The words of a batch of texts in order: numbers into ``vocabulary``, and whether the next word follows
    in the same piece."""

    def __init__(self, texts: pa.Array):
        lowered = pc.ascii_lower(pc.fill_null(texts, ""))
        ended = pc.binary_join_element_wise(lowered, "", "\n")  # a text's end ends its last piece
        ends = np.cumsum(pc.binary_length(ended).to_numpy(zero_copy_only=False).astype(np.int64))
        data = np.frombuffer(b"".join(pc.cast(ended, pa.binary()).to_pylist()), np.uint8)
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        borders = np.concatenate([[0], np.cumsum(kind == 2)])
        self.joined = np.append(borders[start[1:]] == borders[stop[:-1]], False) if len(start) else np.zeros(0, bool)
        self.text = np.searchsorted(ends, start, "right")
        # the words laid end to end are one Arrow array
        kept = data[kind == 0].tobytes()
        offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        coded = pc.dictionary_encode(words)
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary.to_pylist()
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], np.uint64)


def _small(source, max_bytes: int = BATCH_BYTES):
    """Batches of texts cut to about ``max_bytes``; a text that is longer is a batch of its own."""
    for batch in source:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _coded(batch: pa.RecordBatch):
    """``(words, language number per word, language names, language hashes)``"""
    words = Words(batch.column("text"))
    coded = pc.dictionary_encode(batch.column("lang"))
    names = coded.dictionary.to_pylist()
    of_text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass"), seed=1) for n in names], np.uint64)
    return words, of_text[words.text], names, hashes


def _pairs(words: Words, lang: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word within its language, and of each word with the one after it."""
    one = mix(words.hashes[words.ids] ^ hashes[lang]) if len(lang) else np.zeros(0, np.uint64)
    two = mix(one[:-1] * _STEP + one[1:])
    return one, two


def _hashed(source):
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    for batch in _small(source):
        words, lang, _, hashes = _coded(batch)
        one, two = _pairs(words, lang, hashes)
        key, n = np.unique(np.concatenate([one, two[words.joined[:-1]]]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], schema=schema)


def frequent_bitmap(texts: DataFrame, least: int) -> np.ndarray:
    """Words of bits; the bits of all words and pairs seen ``least`` times or more in ``texts(lang, text)`` are
    set. ``BITS_PER_GRAM`` bits a gram, at most ``MAX_BITS`` (32 MB): beyond that more bits are set in vain."""
    counted = texts.mapInArrow(_hashed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = stored(counted.filter(F.col("n") >= least).select("key"), "frequent")
    size = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_GRAM * frequent.count()).bit_length()))
    masks = frequent.groupBy(F.expr(f"(key & {size - 1}L) div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(key & 63L as int)))").alias("mask")
    )
    found = masks.toArrow()  # at most size / 64 rows
    bitmap = np.zeros(size // 64, np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return bitmap


def _is_set(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _longest_grams(broadcast, longest: int):
    """One row per language and gram of a batch; size 0 counts all words."""

    def run(source):
        bitmap = broadcast.value
        for batch in _small(source):
            words, lang, names, hashes = _coded(batch)
            one, two = _pairs(words, lang, hashes)
            out = [[names[i], 0, "", int(n)] for i, n in enumerate(np.bincount(lang, minlength=len(names))) if n]
            goes_on = words.joined.copy()  # the pair that begins here may be frequent
            if len(one):
                goes_on[:-1] &= _is_set(bitmap, two)
            goes_on = np.append(goes_on, np.zeros(longest, bool))
            size, open_ = np.ones(len(lang), np.int64), np.ones(len(lang), bool)
            for k in range(1, longest):
                open_ &= goes_on[k - 1 : k - 1 + len(lang)]
                size += open_
            size[(size == 1) & ~_is_set(bitmap, one)] = 0  # a word that can't be in any candidate
            columns = [pa.array([r[i] for r in out], _GRAMS.field(i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, schema=_GRAMS)
            texts = pa.array([w.decode("utf-8", "surrogatepass") for w in words.vocabulary], pa.string())
            for k in range(1, longest + 1):
                at = np.flatnonzero(size == k)
                if not len(at):
                    continue
                # gram numbers of the batch, one word more at a time, so that they fit 64 bits
                _, code = np.unique(lang[at] * (len(texts) + 1) + words.ids[at], return_inverse=True)
                for i in range(1, k):
                    _, code = np.unique(code.astype(np.int64) * (len(texts) + 1) + words.ids[at + i], return_inverse=True)
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                at = at[first]
                parts = [texts.take(pa.array(words.ids[at + i])) for i in range(k)]
                gram = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                languages = pa.array(names, pa.string()).take(pa.array(lang[at]))
                yield pa.RecordBatch.from_arrays(
                    [languages, pa.array(np.full(len(at), k, np.int8)), gram, pa.array(n.astype(np.int64))], schema=_GRAMS
                )

    return run


def gram_weights(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """``(lang, size, gram, n)``: the longest grams that begin at the words of ``docs(lang, text)``, a stored table.

    Grams of ``longest`` words are the graph's edges, shorter ones the corrections at piece ends and before pairs
    that can't be frequent; size 0 has the number of all words of a language.
    """
    texts = bound_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bitmap = docs.sparkSession.sparkContext.broadcast(frequent_bitmap(texts, least))
    grams = texts.mapInArrow(_longest_grams(bitmap, longest), "lang string, size byte, gram string, n long")
    return stored(grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")


def _prefix(gram: Column) -> Column:
    """A gram without its last word."""
    return F.array_join(F.slice(F.split(gram, " ", -1), 1, F.size(F.split(gram, " ", -1)) - 1), " ")


def _suffix(gram: Column) -> Column:
    """A gram without its first word."""
    return F.array_join(F.slice(F.split(gram, " ", -1), 2, F.size(F.split(gram, " ", -1))), " ")


def compacted(edges: DataFrame) -> DataFrame:
    """``edges(lang, gram, n)`` with ``head, tail`` (nodes), ``path`` and ``place``: the paths that only pass
    nodes of one edge in and one edge out. ``path`` is the number of a path's first edge, ``place`` counts from 0.
    Edges have two words or more. A stored table."""
    numbered = edges.select(
        "lang", "gram", "n", _prefix(F.col("gram")).alias("head"), _suffix(F.col("gram")).alias("tail"),
        F.monotonically_increasing_id().alias("id"),
    )
    numbered = stored(numbered, "edges")
    into = numbered.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("n_in"), F.min("id").alias("before"))
    out = numbered.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("n_out"), F.min("id").alias("id"))
    links = into.filter("n_in = 1").join(out.filter("n_out = 1"), ["lang", "node"]).select("id", "before")
    jumps = numbered.select("id").join(links, "id", "left")
    # first: the edge reached so far, steps: how far away, least: smallest edge passed on the way
    state = jumps.select(
        "id", F.coalesce("before", "id").alias("first"), F.col("before").isNotNull().cast("long").alias("steps"),
        F.col("before").isNull().alias("done"), F.least("id", "before").alias("least"),
    )
    placed, circles = _walked(stored(state, "jumps"))
    if circles is not None:
        # a cycle is opened at its smallest edge
        opened = circles.select("id", "least").join(links, "id").select(
            "id",
            F.when(F.col("id") == F.col("least"), F.col("id")).otherwise(F.col("before")).alias("first"),
            (F.col("id") != F.col("least")).cast("long").alias("steps"),
            (F.col("id") == F.col("least")).alias("done"),
            "least",
        )
        placed = placed.unionByName(_walked(stored(opened, "jumps"))[0])
    paths = placed.select("id", F.col("first").alias("path"), F.col("steps").alias("place"))
    return stored(numbered.join(paths, "id").drop("id"), "paths")


def _walked(state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(edges that reached the start of their path, edges on cycles)`` by pointer doubling."""
    open_ = state.filter("NOT done").count()
    for _ in range(open_.bit_length() + 1):
        if not open_:
            return state, None
        ahead = state.select(F.col("id").alias("first"), F.struct(F.col("first").alias("f"), "steps", "done", "least").alias("a"))
        # finished edges stay where they are; several edges never point at one
        going = state.filter("NOT done").join(ahead, "first").select(
            "id", F.col("a.f").alias("first"), (F.col("steps") + F.col("a.steps")).alias("steps"),
            F.col("a.done").alias("done"), F.least("least", "a.least").alias("least"),
        )
        state = stored(state.filter("done").unionByName(going), "jumps")
        open_ = state.filter("NOT done").count()
    # no path is longer than the steps taken by now: what is left goes round
    return state.filter("done"), state.filter("NOT done") if open_ else None


def path_phrases(paths: DataFrame) -> DataFrame:
    """One row per compacted path: ``lang, phrase, edges, least, most`` (its words, number of edges, smallest and
    largest weight)."""
    one = F.struct("place", "head", F.substring_index("tail", " ", -1).alias("word"))
    rows = paths.groupBy("lang", "path").agg(
        F.array_sort(F.collect_list(one)).alias("walk"), F.count("*").alias("edges"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    phrase = F.concat_ws(" ", F.col("walk")[0]["head"], F.array_join("walk.word", " "))
    return rows.select("lang", phrase.alias("phrase"), "edges", "least", "most")


def phrase_counts(weights: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(counts, paths)``: ``(lang, size, gram, n)`` of all grams of 1 to ``longest`` words seen ``least`` times or
    more, from the graph's flow, and its compacted paths."""
    edges = weights.filter(F.col("size") == longest)
    heavy = edges.filter(F.col("n") >= least).select("lang", "gram", "n")
    counts = heavy.withColumn("size", F.lit(longest))
    if longest == 1:
        return counts, heavy.limit(0)
    paths = compacted(heavy)
    # inside a path a node's flow is the weight of the one edge that leaves it
    inner = paths.filter("place > 0").select("lang", F.col("head").alias("gram"), "n")
    ends = paths.filter("place = 0").groupBy("lang", F.col("head").alias("gram")).agg(F.sum("n").alias("n"))
    light = edges.filter(F.col("n") < least).select("lang", _prefix(F.col("gram")).alias("gram"), "n")
    flow = inner.unionByName(ends).unionByName(light)
    for size in range(longest - 1, 0, -1):
        fixes = weights.filter(F.col("size") == size).select("lang", "gram", "n")
        nodes = flow.unionByName(fixes).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        nodes = stored(nodes, f"flow{size}")
        counts = counts.unionByName(nodes.filter(F.col("n") >= least).withColumn("size", F.lit(size)))
        if size > 1:
            flow = nodes.select("lang", _prefix(F.col("gram")).alias("gram"), "n")
    return stored(counts, "counts"), paths


def _exact(count: str) -> Column:
    """Counts up to 10^15 as numbers whose products stay exact."""
    return F.col(count).cast("decimal(15,0)")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, first: int | None = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of ``docs(lang, text)``.

    ``a`` is a phrase's count, ``l`` and ``r`` those of the parts of its weakest cut, ``n`` the words of the language,
    ``score`` is ``floor(10^6 a^2 / (l r))``. A phrase inside a longer one that has ``covered`` percent of its count is
    left out. ``first`` phrases a language, all with None.
    """
    weights = gram_weights(docs, longest, least)
    counts, _ = phrase_counts(weights, longest, least)
    phrases = counts.filter("size > 1")
    words = F.split("gram", " ", -1)
    part = lambda begin, n: F.array_join(F.slice(F.col("w"), begin, n), " ")

    cuts = phrases.withColumn("w", words).withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select(
        "lang", "gram", F.col("n").alias("a"), "k",
        part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    parts = counts.filter(F.col("size") < longest)
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("a15", _exact("a")).withColumn("l15", _exact("l")).withColumn("r15", _exact("r"))
    cuts = cuts.withColumn("score", F.expr("(a15 * a15 * cast(1000000 as decimal(7,0))) div (l15 * r15)"))
    weakest = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the shorter phrases inside each candidate
    inside = phrases.filter("size > 2").withColumn("w", words).withColumn("m", F.explode(F.expr("sequence(2, size - 1)")))
    inside = inside.withColumn("at", F.explode(F.expr("sequence(1, size - m + 1)")))
    inside = inside.groupBy("lang", part(F.col("at"), F.col("m")).alias("gram")).agg(F.max("n").alias("within"))
    kept = weakest.join(inside, ["lang", "gram"], "left")
    kept = kept.filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * covered))
    totals = weights.filter("size = 0").select("lang", F.col("n").alias("words"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "gram")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if first is not None:
        ranked = ranked.filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score"
    )
