"""Pairs, holdouts and stratified samples: seeded, exact in size, independent of partitioning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom.functions.taxonomy import FAMILIES, Taxonomy, matched_categories
from matchloom.operators.layout import checkpointed
from matchloom.operators.phrase_match import find_categories
from matchloom.operators.ranking import hash_order, with_hash_position

# Strata whose thresholds are sent to every task; more of them are joined by a shuffle.
BROADCAST_STRATA = 10_000


def extra_categories(resumes: DataFrame, taxonomy: Taxonomy = FAMILIES, category: str = "resume_category") -> DataFrame:
    """``category, keyword``: each resume category the taxonomy lacks, with its own words as its only keyword.

    The rows are for ``build_pairs`` and ``find_categories``, which join them; their number is not bounded.
    """
    unknown = resumes.select(F.col(category).alias("category")).filter(~F.col("category").isin(*taxonomy)).distinct()
    return unknown.filter("category <> ''").withColumn("keyword", F.replace("category", F.lit("-"), F.lit(" ")))


def category_matches(
    postings: DataFrame, taxonomy: Taxonomy = FAMILIES, title: str = "job_title", unicode: bool = True
) -> DataFrame:
    """One row per posting and category whose keywords stand in its title, so that labelling is an
    equi join on ``category`` and never a pattern join."""
    return postings.withColumn("category", F.explode(matched_categories(title, taxonomy, unicode)))


def _signatures(
    postings: DataFrame, taxonomy: Taxonomy, title: str, unicode: bool, categories: DataFrame | None
) -> DataFrame:
    """``job_id, signature``: the sorted categories of each posting, by pattern and by equi join."""
    by_pattern = postings.select("job_id", title, matched_categories(title, taxonomy, unicode).alias("signature"))
    if categories is None:
        return by_pattern.select("job_id", F.array_sort("signature").alias("signature"))
    # the categories of one title, at most one for each run of its words and phrase
    found = find_categories(postings.select(title).distinct(), categories, title, unicode)
    found = found.groupBy(F.col(title).alias("_titled")).agg(F.collect_set("category").alias("_more"))
    both = by_pattern.join(found, F.col(title) == F.col("_titled"), "left")
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return both.select("job_id", F.array_sort(F.array_union("signature", more)).alias("signature"))


def _with_starts(sizes: DataFrame, seed: int, bits: int = 10) -> DataFrame:
    """``signature, n, start``: signatures laid end to end in hash order; each hash bucket is summed by itself."""
    hashed = sizes.withColumn("_hash", hash_order(["signature"], seed)).withColumn("_bucket", F.shiftright("_hash", 64 - bits))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = hashed.groupBy("_bucket").agg(F.sum("n").alias("_rows"))
    offsets = offsets.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_bucket").orderBy("_hash", "signature").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return hashed.join(offsets, F.col("_bucket") == F.col("_b")).select("signature", "n", start.alias("start"))


def _category_ranges(placed: DataFrame, everything: Column) -> DataFrame:
    """``category, relevance, low, n, place``: the postings that match a category (relevance 1) and those that don't
    (0), numbered from 0 each, as ranges ``[low, low + n)`` over the places of all postings.

    Signatures that hold the category are its hit ranges; the gaps between them are its miss ranges, so a category has
    at most two ranges for each signature it stands in and one more.
    """
    order = W.partitionBy("category").orderBy("start")
    hits = placed.select(F.explode("signature").alias("category"), "start", "n")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hits = hits.select(
        "*", before.alias("before"), F.lag(F.col("start") + F.col("n"), 1, 0).over(order).alias("gap"),
        F.lead("start").over(order).isNull().alias("last"),
    )
    end = F.col("start") + F.col("n")

    def part(relevance: int, low: Column, n: Column, place: Column) -> Column:
        return F.struct(F.lit(relevance).alias("relevance"), low.alias("low"), n.alias("n"), place.alias("place"))

    parts = F.array(
        part(1, F.col("before"), F.col("n"), F.col("start")),
        part(0, F.col("gap") - F.col("before"), F.col("start") - F.col("gap"), F.col("gap")),
        part(0, end - F.col("before") - F.col("n"), F.when(F.col("last"), everything - end).otherwise(F.lit(0)), end),
    )
    return hits.select("category", F.inline(parts)).filter("n > 0")


def _primes(count: int, above: int) -> list[int]:
    found: list[int] = []
    number = above
    while len(found) < count:
        number += 1
        if all(number % d for d in range(2, int(number**0.5) + 1)):
            found.append(number)
    return found


_STRIDES = _primes(64, 1_000_000)


def _usable_strides(total: Column) -> Column:
    return F.filter(F.array(*[F.lit(p).cast("long") for p in _STRIDES]), lambda p: F.pmod(total, p) != 0)


def _draws(total: Column, wanted: Column, usable: Column, *seed: Column) -> Column:
    """``wanted`` distinct positions in ``[0, total)``: an affine walk with seeded offset and stride.

    The stride is a product of two seeded primes that do not divide ``total``, hence coprime to it,
    hence the walk visits distinct positions.
    """

    def pick(name: str) -> Column:
        return F.element_at(usable, (F.pmod(F.xxhash64(F.lit(name), *seed), F.size(usable)) + 1).cast("int"))

    stride = F.pmod(pick("first") * pick("second"), total)
    offset = F.pmod(F.xxhash64(F.lit("offset"), *seed), total)
    walk = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(wanted - 1, F.lit(0)).cast("long")),
        lambda i: F.pmod(offset + i * stride, total),
    )
    return F.when(wanted > 0, walk).otherwise(F.array().cast("array<bigint>"))


def build_pairs(
    resumes: DataFrame,
    postings: DataFrame,
    taxonomy: Taxonomy = FAMILIES,
    negative_ratio: int = 3,
    positives: int = 1,
    seed: int = 42,
    title: str = "job_title",
    unicode: bool = True,
    categories: DataFrame | None = None,
) -> DataFrame:
    """``resume_id, resume_category, job_id, relevance``: sampled relevance pairs.

    Each resume draws ``positives`` postings that match its category and ``negative_ratio`` times as
    many that do not (fewer when there are fewer); a resume without a match is skipped. ``categories`` are further
    ``(category, keyword)`` rows beside the taxonomy, any number of them.

    Resumes and postings are never multiplied: postings are numbered so that those with the same set of categories lie
    together, and a category is a set of ranges of these numbers. Ranges are cut into as many equal bins as a category
    has ranges, so a draw meets two of them on average; it is joined on its bin, then with the posting on the number.
    """
    signed = checkpointed(_signatures(postings.select("job_id", title), taxonomy, title, unicode, categories))
    sizes = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    placed = checkpointed(_with_starts(sizes, seed))
    everything = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    slots = with_hash_position(signed, ["job_id"], ["signature"], seed, "_slot")
    numbered = slots.join(placed.select("signature", "start"), "signature").select(
        "job_id", (F.col("start") + F.col("_slot") - 1).alias("_place")
    )
    ranges = _category_ranges(placed, everything)
    totals = ranges.groupBy("category", "relevance").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("ranges"))
    totals = totals.withColumn("width", F.ceil(F.col("total") / F.col("ranges")))

    def side(relevance: int, name: str) -> DataFrame:
        return totals.filter(F.col("relevance") == relevance).select(
            "category",
            F.col("total").alias(f"n_{name}"),
            F.col("width").alias(f"{name}_width"),
            _usable_strides(F.col("total")).alias(f"{name}_strides"),
        )

    offers = side(1, "hit").join(side(0, "miss"), "category", "left")
    n_pos = F.least(F.col("n_hit"), F.lit(positives))
    n_neg = F.least(
        F.coalesce("n_miss", F.lit(0)), F.greatest(n_pos, F.lit(1)) * F.greatest(F.lit(negative_ratio), F.lit(1))
    )

    def drawn(name: str, wanted: Column, label: int) -> Column:
        total = F.coalesce(F.col(f"n_{name}"), F.lit(1))  # no such posting: nothing is wanted either
        places = _draws(total, wanted, F.col(f"{name}_strides"), F.lit(seed), F.lit(label), F.col("resume_id"), F.col("resume_category"))

        def locate(place: Column) -> Column:
            bin_ = F.floor(place / F.col(f"{name}_width"))
            return F.struct(F.lit(label).alias("relevance"), bin_.alias("bin"), place.alias("drawn"))

        return F.transform(places, locate)

    none = F.array().cast("array<struct<relevance:int,bin:bigint,drawn:bigint>>")
    draws = (
        resumes.select("resume_id", "resume_category")
        .join(offers, F.col("resume_category") == F.col("category"))
        .select(
            "resume_id", "resume_category",
            F.inline(F.concat(drawn("hit", n_pos, 1), F.coalesce(drawn("miss", n_neg, 0), none))),
        )
    )
    bins = ranges.join(totals.select("category", "relevance", "width"), ["category", "relevance"]).select(
        F.col("category").alias("resume_category"), "relevance", "low", "n", "place",
        F.explode(
            F.sequence(F.floor(F.col("low") / F.col("width")), F.floor((F.col("low") + F.col("n") - 1) / F.col("width")))
        ).alias("bin"),
    )
    inside = (F.col("low") <= F.col("drawn")) & (F.col("drawn") < F.col("low") + F.col("n"))
    found = draws.join(bins, ["resume_category", "relevance", "bin"]).filter(inside)
    return (
        found.withColumn("_place", F.col("place") + F.col("drawn") - F.col("low"))
        .join(numbered, "_place")
        .groupBy("resume_id", "job_id")
        # an id may stand for resumes of several categories: category and label come from one draw
        .agg(F.min(F.struct("resume_category", "relevance")).alias("_draw"))
        .select("resume_id", "_draw.resume_category", "job_id", "_draw.relevance")
    )


def attach_texts(pairs: DataFrame, resumes: DataFrame, postings: DataFrame) -> DataFrame:
    """Bring the texts back to pairs of ids."""
    return (
        pairs.join(resumes.select("resume_id", F.col("text").alias("resume_text")), "resume_id")
        .join(postings.select("job_id", "job_title", F.col("text").alias("job_text")), "job_id")
        .select("resume_id", "resume_category", "resume_text", "job_id", "job_title", "job_text", "relevance")
    )


def _hash_key(keys: Sequence[str], seed: int) -> Column:
    return F.struct(hash_order(keys, seed).alias("hash"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _hash_cuts(
    rows: DataFrame, keys: Sequence[str], by: Sequence[str], wanted: Callable[[DataFrame], DataFrame], seed: int, bits: int = 10
) -> DataFrame:
    """``_c_<by>, _cut, _take, _copies``: the last key, in the seeded order of (hash, keys), among the first
    ``_wanted`` rows of each stratum, how many rows with that key are taken and how many there are.

    ``wanted`` adds ``_wanted`` to a table of strata. Counts of hash buckets name the one bucket a cut lies in; earlier
    ones are taken whole, later ones not at all, so only the keys of that bucket are put in order. A stratum that
    wants no row has no cut. The cuts, one row a stratum, are checkpointed.
    """
    narrow = rows.select(*by, _hash_key(keys, seed).alias("_cut")).withColumn(
        "_bucket", F.shiftright("_cut.hash", 64 - bits)
    )
    counts = narrow.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    held = wanted(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    held = held.filter((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_n")))
    where = [*by, "_bucket"]
    held = held.select(*[F.col(c).alias(f"_c_{c}") for c in where], (F.col("_wanted") - F.col("_before")).alias("_need"))
    near = narrow.join(held, _same(where)).groupBy(*[f"_c_{c}" for c in by], "_cut", "_need").agg(F.count(F.lit(1)).alias("_copies"))
    order = W.partitionBy(*[f"_c_{c}" for c in by]).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    cuts = near.withColumn("_take", F.col("_need") - F.coalesce(F.sum("_copies").over(order), F.lit(0)))
    return checkpointed(cuts.filter((F.col("_take") > 0) & (F.col("_take") <= F.col("_copies"))).drop("_need"))


def _same(columns: Sequence[str]) -> Column:
    return reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_c_{c}")), columns, F.lit(True))


def take_by_hash(
    df: DataFrame, keys: Sequence[str], by: str, sizes: DataFrame, wanted: str, seed: int = 42, name: str = "_taken"
) -> DataFrame:
    """``df`` with a flag: whether the row is among the first ``wanted`` of its stratum in seeded order of ``keys``.

    ``sizes(by, wanted)`` has one row a stratum; null is a stratum. Rows are compared with the cut of their stratum where
    they are; none is shuffled. Beyond ``BROADCAST_STRATA`` strata the cuts are joined by a shuffle. Rows with the
    same keys as the cut are ranked among themselves, in any order, so sizes stay exact.
    """
    asked = sizes.select(F.col(by).alias(f"_c_{by}"), F.col(wanted).alias("_wanted"))
    cuts = _hash_cuts(df, keys, [by], lambda t: t.join(asked, _same([by])).drop(f"_c_{by}"), seed)
    few = cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    tied = not cuts.filter("_take < _copies").isEmpty()
    joined = df.withColumn("_key", _hash_key(keys, seed)).join(F.broadcast(cuts) if few else cuts, _same([by]), "left")
    extra = ["_key", "_cut", "_take", "_copies", f"_c_{by}"]
    flag = F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))
    if not tied:
        return joined.withColumn(name, flag).drop(*extra)
    open_ = F.coalesce((F.col("_key") == F.col("_cut")) & (F.col("_take") < F.col("_copies")), F.lit(False))
    rank = F.row_number().over(W.partitionBy(f"_c_{by}").orderBy("_key"))
    copies = joined.filter(open_).withColumn(name, rank <= F.col("_take"))
    return joined.filter(~open_).withColumn(name, flag).unionByName(copies).drop(*extra)


def _held_groups(pairs: DataFrame, group: str, fraction: float, seed: int) -> Column:
    """Whether a row's group is held out, by comparison with one cut; nothing is joined or shuffled."""
    groups = pairs.select(group).distinct()
    n = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    cuts = _hash_cuts(groups, [group], (), lambda t: t.withColumn("_wanted", F.ceil(F.lit(fraction) * n)), seed)
    return F.coalesce(_hash_key([group], seed) <= cuts.select("_cut").scalar(), F.lit(False))


def group_sides(pairs: DataFrame, group: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``group, is_eval``: exactly ceil(fraction x groups) groups are held out; null is a group."""
    return pairs.select(group).distinct().select(group, _held_groups(pairs, group, fraction, seed).alias("is_eval"))


def holdout_groups(
    pairs: DataFrame, fraction: float = 0.2, group: str = "resume_id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) with every group wholly on one side."""
    held = _held_groups(pairs, group, fraction, seed)
    return pairs.filter(~held), pairs.filter(held)


def strata_sizes(rows: DataFrame, strata: str, fraction: float = 0.2) -> DataFrame:
    """``strata, n, n_eval``: ceil(fraction x rows) eval rows split over the strata by largest remainder
    of the training side (ties to the smaller stratum value)."""
    counts = rows.groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()
    shared = (
        counts.withColumn("_total", F.sum("n").over(everything))
        .withColumn("_train", F.col("_total") - F.ceil(F.lit(fraction) * F.col("_total")))
        .withColumn("_quota", F.col("n") * F.col("_train") / F.col("_total"))
        .withColumn("_floor", F.floor("_quota"))
        .withColumn("_left", F.col("_train") - F.sum("_floor").over(everything))
    )
    by_remainder = W.orderBy(F.desc(F.col("_quota") - F.col("_floor")), F.asc(strata))
    return shared.withColumn("_extra", (F.row_number().over(by_remainder) <= F.col("_left")).cast("int")).select(
        strata, "n", (F.col("n") - F.col("_floor") - F.col("_extra")).alias("n_eval")
    )


def holdout_rows(
    rows: DataFrame, keys: Sequence[str], strata: str = "relevance", fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) by rows, each stratum in proportion; for input with a single group."""
    sizes = strata_sizes(rows, strata, fraction).select(strata, "n_eval")
    flagged = take_by_hash(rows, keys, strata, sizes, "n_eval", seed)
    return flagged.filter("not _taken").drop("_taken"), flagged.filter("_taken").drop("_taken")


def holdout(
    pairs: DataFrame,
    fraction: float = 0.2,
    group: str = "resume_id",
    strata: str = "relevance",
    keys: Sequence[str] = ("resume_id", "job_id"),
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Group holdout when there are two groups or more, else the stratified row holdout.
    Empty input gives two empty outputs."""
    grouped = group in pairs.columns and len(pairs.select(group).distinct().limit(2).collect()) > 1
    if grouped:
        return holdout_groups(pairs, fraction, group, seed)
    return holdout_rows(pairs, [k for k in keys if k in pairs.columns], strata, fraction, seed)


def sample_sizes(df: DataFrame, by: str, target: int, floor: int = 200) -> DataFrame:
    """``by, n, n_sample``: proportional share of ``target`` (halves to even), at least ``floor``, at
    most the stratum."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    share = F.bround(F.lit(target) * F.col("n") / total, 0).cast("long")
    return counts.withColumn("n_sample", F.least(F.col("n"), F.greatest(share, F.lit(floor))))


def stratified_sample(
    df: DataFrame, by: str, target: int, floor: int = 200, seed: int = 42, key: str = "job_id"
) -> DataFrame:
    """Sample each stratum to its ``sample_sizes``; ids stay, and the floor may exceed the target."""
    sizes = sample_sizes(df, by, target, floor).select(by, "n_sample")
    return take_by_hash(df, [key], by, sizes, "n_sample", seed).filter("_taken").drop("_taken")
