"""Dictionary matches by equi join: phrases of any number, found in texts as whole tokens.

A text is cut into parts, each a run of token characters or one other character. A phrase is a run of parts, so
all runs of the lengths that phrases have are joined with the phrases on their text; runs that a bitmap of the phrases
rules out are dropped before any exchange. No pattern is built, and neither side is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from matchloom.functions.skills import TOKEN_CHARS
from matchloom.functions.text import normalize_text
from matchloom.operators.key_filter import possible_rows
from matchloom.operators.layout import checkpointed

_TOKEN = rf"\A{TOKEN_CHARS}"
_PARTS = rf"(?s){TOKEN_CHARS}+|[^a-z0-9+#]"


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_PARTS), 0)


def _runs(parts: Column, lengths: list[int]) -> Column:
    """``(start, length, phrase, before, after)`` of every run of parts that neither begins nor ends with a blank."""
    part = lambda i: F.coalesce(F.get("_parts", i), F.lit(""))
    starts = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: part(i) != " ")

    def run(i, n):
        return F.struct(
            i.alias("start"), n.alias("length"), F.array_join(F.slice("_parts", i + 1, n), "").alias("phrase"),
            F.when(i > 0, part(i - 1)).otherwise("").alias("before"), part(i + n).alias("after"),
        )

    fits = lambda i: F.filter(
        F.array(*[F.lit(n) for n in lengths]), lambda n: (i + n <= F.size("_parts")) & (part(i + n - 1) != " ")
    )
    return F.when(F.size(parts) > 0, F.flatten(F.transform(starts, lambda i: F.transform(fits(i), lambda n: run(i, n)))))


def find_phrases(texts: DataFrame, phrases: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """``id, place, phrase`` for each match of ``phrases(phrase)`` in ``texts(id, text)``; an id is one text.

    Matches are whole tokens in any case, leftmost first, the longest of those that begin at a place, and don't overlap.
    ``place`` counts parts. A null text has none; phrases that are null or blank match nothing. The phrases are
    checkpointed: they are read several times.
    """
    known = phrases.select(F.lower(F.trim("phrase")).alias("phrase")).filter("phrase <> ''").distinct()
    known = checkpointed(known.withColumn("_n", F.size(_parts(F.col("phrase")))))
    lengths = sorted(r[0] for r in known.select("_n").distinct().collect())  # few: phrases are short
    cut = texts.select(F.col(id_).alias("_id"), _parts(F.col(text)).alias("_parts"))
    runs = cut.select("_id", F.inline(_runs(F.col("_parts"), lengths))) if lengths else None
    if runs is None:
        return texts.select(F.col(id_).alias("id"), F.lit(0).alias("place"), F.lit("").alias("phrase")).filter("false")
    # a phrase that begins or ends with a symbol must not be part of a longer token there
    inside = (~F.col("phrase").rlike(_TOKEN) & F.col("before").rlike(_TOKEN)) | (
        ~F.col("phrase").rlike(rf"{TOKEN_CHARS}\z") & F.col("after").rlike(_TOKEN)
    )
    possible = possible_rows(runs.filter(~inside).drop("before", "after"), known, "phrase")
    hits = possible.join(known.select("phrase"), "phrase").distinct()
    # hits that overlap are settled together; a hit that begins after all before it have ended begins a new chain
    in_text = W.partitionBy("_id").orderBy("start", F.desc("length"), F.desc("phrase"))
    ended = F.max(F.col("start") + F.col("length")).over(in_text.rowsBetween(W.unboundedPreceding, -1))
    chained = hits.withColumn("_new", F.coalesce((F.col("start") >= ended).cast("int"), F.lit(1))).withColumn(
        "_chain", F.sum("_new").over(in_text.rowsBetween(W.unboundedPreceding, 0))
    )
    longest = chained.groupBy("_id", "_chain", "start").agg(F.max(F.struct("length", "phrase")).alias("_hit"))
    in_order = F.array_sort(F.collect_list(F.struct("start", "_hit.length", "_hit.phrase")))  # matches of one chain
    none = F.array().cast("array<struct<start:int,phrase:string>>")
    kept = F.aggregate(
        in_order,
        F.struct(F.lit(0).alias("end"), none.alias("kept")),
        lambda state, hit: F.when(hit["start"] < state["end"], state).otherwise(
            F.struct(
                (hit["start"] + hit["length"]).alias("end"),
                F.concat(state["kept"], F.array(F.struct(hit["start"].alias("start"), hit["phrase"].alias("phrase")))).alias("kept"),
            )
        ),
    )["kept"]
    found = longest.groupBy("_id", "_chain").agg(kept.alias("_kept")).select("_id", F.inline("_kept"))
    return found.select(F.col("_id").alias(id_), F.col("start").alias("place"), "phrase")


def read_lexicon_table(spark: SparkSession, path: str) -> DataFrame:
    """``canonical, domain, aliases`` rows (JSON lines), any number of them."""
    return spark.read.schema("canonical string, domain string, aliases array<string>").json(path)


def find_skills(texts: DataFrame, lexicon: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """``id, skills``: the sorted distinct canonical skills of every text, by a lexicon of any size given as rows
    ``(canonical, aliases)``. Twin of ``functions.skills.extract_skills``; where skills share an alias, all are found."""
    aliases = lexicon.select("canonical", F.explode("aliases").alias("phrase")).withColumn("phrase", F.lower(F.trim("phrase")))
    aliases = checkpointed(aliases.distinct())
    found = find_phrases(texts, aliases, id_, text).select(id_, "phrase").distinct()
    skills = found.join(aliases, "phrase").groupBy(id_).agg(F.array_sort(F.collect_set("canonical")).alias("skills"))
    none = F.array().cast("array<string>")
    return texts.select(id_).join(skills, id_, "left").withColumn("skills", F.coalesce("skills", none))


def find_categories(
    postings: DataFrame, categories: DataFrame, title: str = "job_title", unicode: bool = True
) -> DataFrame:
    """``postings`` with ``category``, one row per posting and category one of whose keywords stands in the title.

    ``categories(category, keyword)`` has any number of rows. Twin of ``operators.sampling.category_matches``; keywords
    are words of the normalised title.
    """
    words = lambda c: F.filter(F.split(normalize_text(c, unicode), " "), lambda w: w != "")
    known = categories.select("category", words("keyword").alias("_words")).filter(F.size("_words") > 0)
    known = known.select("category", F.array_join("_words", " ").alias("_phrase"), F.size("_words").alias("_n")).distinct()
    lengths = sorted(r[0] for r in known.select("_n").distinct().collect())
    if not lengths:
        return postings.withColumn("category", F.lit(None).cast("string")).filter("false")

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size("_words") - n + 1)
        found = F.transform(places, lambda i: F.array_join(F.slice("_words", i, n), " "))
        return F.when(F.size("_words") >= n, found).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[runs(n) for n in lengths]))
    titles = postings.select(title).distinct().withColumn("_words", words(title))
    found = titles.select(title, F.explode(F.array_distinct(grams)).alias("_phrase")).join(known, "_phrase")
    return postings.join(found.select(title, "category").distinct(), title).select(*postings.columns, "category")
