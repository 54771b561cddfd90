"""Mixing sources to target weights by a low-discrepancy schedule.

1. A document's size is its number of words. Sources, sorted by code point with null last, weigh 3, 1, 2,
   3, 1, 2, ... and share ``share`` times the sum of all sizes; no source gets more than ``most`` times its
   own size, what exceeds that is shared out again by weight.
2. Each source's documents are shuffled by a seeded hash and laid end to end; the line is cut into blocks of
   ``block_words`` words.
3. Slot i of the schedule is the van der Corput number of i in base 2, mapped through the cumulative targets
   to a source. The r-th slot of a source takes its block r modulo the number of its blocks, so any run of
   slots is close to the target weights, and a source's blocks are taken evenly.
4. A source whose slots miss its target by more than its largest document or a hundredth of the target (one of
   few blocks) is settled in words: its line is read from its start, and again from its start, for exactly its
   target, rounded to a word. It keeps its slots up to that number of words and gets the missing ones, evenly spread.
5. A document's ``taken`` is the sum of its words that are read, repeats counted.

The end-to-end line is numbered by ranges of the shuffling hash, the slots by ranges of i: a source that
holds a third of all rows or slots is spread over many tasks.

Edge cases: a null text has size 0; a document without words and a source without words take nothing; equal
rows have equal places in the order and are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from matchloom.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
RANGES = 1024
MAX_BLOCK_WORDS, MIN_SLOTS = 4096, 1 << 16
MAX_MISS = 0.01


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)``, one row per source of ``sizes(source, size)``.

    Sources fill up to ``least(level * weight, most * size)`` with one level for all: sorted by their
    limit per weight, the sources before some place are at their limit and the level of the others follows
    from what is left.
    """
    by_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    # windows over one row per source
    name = F.col("source").asc_nulls_last()
    place = F.row_number().over(Window.orderBy(name)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    rows = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), name)
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("level", left / free)
    # the level that holds is that of the first source which its limit doesn't stop
    going = F.col("level") * F.col("weight") < F.col("limit")
    level = F.min(F.when(going, F.struct("place", "level"))).over(whole)["level"]
    target = F.least(F.col("shared") * F.col("weight"), "limit")  # all stopped: no level
    return rows.withColumn("shared", level).select("source", "source_size", F.coalesce(target, "limit").alias("target"))


def van_der_corput(i: Column) -> Column:
    """The 32 low bits of ``i`` in reverse order, as an unsigned number."""
    i = i.bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        mask = F.lit(mask).cast("long")
        i = F.shiftright(i, shift).bitwiseAND(mask).bitwiseOR(F.shiftleft(i.bitwiseAND(mask), shift))
    return i


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _before(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``(*keys, base)``: by the first key, the sum of ``value`` over the earlier ranges (the second key)."""
    sums = rows.groupBy(*keys).agg(value.alias("base"))
    earlier = Window.partitionBy(keys[0]).orderBy(keys[1]).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, F.coalesce(F.sum("base").over(earlier), F.lit(0)).alias("base"))


def schedule(spark: SparkSession, targets: DataFrame, block_words: int) -> DataFrame:
    """``(slot, key, rank, blocks)``: the source of every slot and how many earlier slots it has had.

    ``targets(source, source_size, target)`` has one row per source, the slots are about the sum of targets
    over ``block_words``. Slots beyond ``2^32`` begin the sequence of points anew.
    """
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = int(-(-total // block_words))
    given = targets.filter("target > 0")
    name = F.col("source").asc_nulls_last()
    end = F.sum("target").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)) / F.lit(total or 1.0)
    shares = given.select(
        _key(F.col("source")).alias("key"),
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
        F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())).alias("last"),
        end.alias("high"),
        "source",
    )
    # rounding must leave no gap: a source begins where the one before ends, the last ends beyond all points
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy(name)), F.lit(0.0)))
    shares = shares.withColumn("high", F.when(F.col("last") == 1, F.lit(1.0)).otherwise(F.least("high", F.lit(1.0))))
    cell = lambda x: F.floor(x * RANGES).cast("int")
    shares = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = spark.range(slots).withColumn("point", van_der_corput(F.col("id")) / F.lit(float(1 << 32)))
    points = points.withColumn("cell", cell(F.col("point"))).alias("p")
    hit = (F.col("p.cell") == F.col("s.cell")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    hits = points.join(shares.alias("s"), hit)
    hits = hits.select(F.col("id").alias("slot"), "key", "blocks", F.expr(f"id div {max(1, slots // RANGES)}").alias("range"))
    base = _before(hits, ["key", "range"], F.count("*"))
    within = F.row_number().over(Window.partitionBy("key", "range").orderBy("slot")) - 1
    hits = hits.withColumn("within", within).join(base, ["key", "range"])
    return hits.select("slot", "key", (F.col("base") + F.col("within")).alias("rank"), "blocks")


def _settled(targets: DataFrame, slots: DataFrame, largest: DataFrame, block_words: int) -> DataFrame:
    """``(key, source_size, target, slots, words)``, one row per source; ``words`` is the rounded target of a source
    that its ``slots(key, block, blocks)`` miss, else null. ``largest(key, largest)`` has the size of its largest document."""
    by_key = targets.select(_key(F.col("source")).alias("key"), "source_size", "target").join(largest, "key")
    # every block is full but the last
    by_slots = slots.groupBy("key").agg(
        F.count("*").alias("slots"), F.sum((F.col("block") == F.col("blocks") - 1).cast("long")).alias("ends"), F.max("blocks").alias("blocks")
    )
    rows = by_key.join(by_slots, "key", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    read = F.col("slots") * block_words - F.col("ends") * (F.col("blocks") * block_words - F.col("source_size"))
    miss = F.abs(F.col("target") - F.coalesce(read, F.lit(0)))
    missed = miss > F.least(F.col("largest").cast("double"), F.col("target") * MAX_MISS)
    words = F.when(missed, F.round("target").cast("long"))
    return rows.select("key", "source_size", "target", "slots", words.alias("words"))


def _turns(slots: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """``slots`` with those of settled sources cut or filled up to their words; ``block`` is null there."""
    settled = sources.filter("words IS NOT NULL").withColumn("turns", F.ceil(F.col("words") / block_words))
    settled = settled.select("key", "slots", "turns")
    kept = slots.join(settled.select("key", "turns"), "key", "left").filter("turns IS NULL OR rank < turns")
    block = F.when(F.col("turns").isNull(), F.col("block"))
    kept = kept.select("slot", "key", "rank", block.alias("block"))
    # a source misses few slots, however many it has
    more = settled.filter("turns > slots").withColumn("rank", F.explode(F.expr("sequence(slots, turns - 1)")))
    end = slots.agg(F.coalesce(F.max("slot") + 1, F.lit(1)).alias("end"))
    place = (F.col("rank") - F.col("slots") + 0.5) / (F.col("turns") - F.col("slots")) * F.col("end")
    more = more.crossJoin(end).select(F.floor(place).alias("slot"), "key", "rank", F.lit(None).cast("long").alias("block"))
    return kept.unionByName(more)


def _lined_up(sized: DataFrame, seed: int) -> DataFrame:
    """``sized(doc_id, size, row, key)`` with ``start``, the words before it in its source's shuffled line."""
    mixed_up = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    # equal ranges of the hash, by its first 12 bits
    ranged = sized.withColumn("hash", mixed_up).withColumn("range", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    base = _before(ranged, ["key", "range"], F.sum("size"))
    order = Window.partitionBy("key", "range").orderBy("hash", "doc_id", "size", "row")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.withColumn("before", before).join(base, ["key", "range"])
    return ranged.select("row", "key", "size", (F.col("base") + F.col("before")).alias("start"))


def mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """``(documents, schedule)`` of ``docs(doc_id, source, text)``.

    ``documents``: ``doc_id, size, source_size, target, taken`` and the row's place ``row`` for each row of
    ``docs``, a stored table. ``schedule``: ``slot, key, rank, block``, the order in which blocks are read. The
    turns of a settled source have no ``block``: turn ``rank`` reads the words of its repeated line from
    ``rank * block_words`` on, up to a block of them and its target.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row"))
    sized = stored(sized.withColumn("key", _key(F.col("source"))), "sizes")
    targets = stored(source_targets(sized, share, most, weights), "targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    block_words = int(max(1, min(MAX_BLOCK_WORDS, total // MIN_SLOTS)))

    # rounding may give a source one slot too many; no block is read more often than `most` allows
    slots = schedule(docs.sparkSession, targets, block_words).filter(F.col("rank") < F.floor(F.lit(most) * F.col("blocks")))
    slots = stored(slots.select("slot", "key", "rank", (F.col("rank") % F.col("blocks")).alias("block"), "blocks"), "slots")
    times = slots.groupBy("key", "block").agg(F.count("*").alias("times"))
    largest = sized.groupBy("key").agg(F.max("size").alias("largest"))
    sources = stored(_settled(targets, slots, largest, block_words), "sources")

    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    lined = _lined_up(sized, seed).filter("size > 0").join(sources.select("key", "source_size", "words"), "key")
    blocks = F.when(F.col("words").isNull(), F.sequence(first, last)).otherwise(F.array(first))
    parts = lined.withColumn("block", F.explode(blocks)).join(times, ["key", "block"], "left")
    begin, end = F.col("block") * block_words, (F.col("block") + 1) * block_words
    by_slots = (F.least(F.col("start") + F.col("size"), end) - F.greatest("start", begin)) * F.coalesce("times", F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.expr("words % source_size") - F.col("start")))
    settled = F.expr("words div source_size") * F.col("size") + rest
    taken = parts.groupBy("row").agg(F.sum(F.when(F.col("words").isNull(), by_slots).otherwise(settled)).alias("taken"))
    by_key = sources.select("key", "source_size", "target")
    rows = sized.join(by_key, "key").join(taken, "row", "left")
    rows = rows.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return rows, _turns(slots, sources, block_words)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix reads it: each row as often as its words are taken, a part counting as a whole."""
    rows, _ = mix(docs, **options)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    read = rows.filter("taken > 0").select(F.col("row").alias("__row"), copies.alias("__copies"))
    repeated = docs.withColumn("__row", F.monotonically_increasing_id()).join(read, "__row")
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
