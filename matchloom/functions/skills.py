"""Skill extraction with a lexicon that is a parameter.

A lexicon is a list of ``Skill(canonical, domain, aliases)``, read from a file with ``read_lexicon``. None is built in.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Skill(NamedTuple):
    canonical: str
    domain: str
    aliases: tuple[str, ...]


# Fixed value: characters that belong to a token. The dot is left out so that a sentence may end
# right after a skill.
TOKEN_CHARS = "[a-z0-9+#]"

MAX_LEXICON_ROWS = 20_000


def read_lexicon(spark: SparkSession, path: str) -> tuple[Skill, ...]:
    """Read ``{"canonical", "domain", "aliases": [...]}`` rows (JSON lines). The lexicon becomes a
    pattern, so it is a bounded driver-side parameter; a larger file is refused."""
    table = spark.read.schema("canonical string, domain string, aliases array<string>").json(path)
    rows = table.limit(MAX_LEXICON_ROWS + 1).collect()
    if len(rows) > MAX_LEXICON_ROWS:
        raise ValueError(f"a skill lexicon may have at most {MAX_LEXICON_ROWS} rows")
    return tuple(Skill(r.canonical, r.domain, tuple(r.aliases)) for r in rows)


def word_lexicon(words: Sequence[str], domain: str = "words") -> tuple[Skill, ...]:
    """A lexicon in which every word is its own skill."""
    return tuple(Skill(w, domain, (w,)) for w in words)


def _alias_map(lexicon: Sequence[Skill]) -> dict[str, str]:
    return {alias.lower(): skill.canonical for skill in lexicon for alias in skill.aliases}


def alias_pattern(lexicon: Sequence[Skill]) -> str:
    """One alternation, longest alias first. Aliases are grouped by their first character so that a
    position is tried against a few aliases and not against all; two aliases with different first
    characters can never match at the same place, so the grouping does not change what is found."""
    by_first: dict[str, list[str]] = {}
    for alias in sorted(_alias_map(lexicon), key=lambda a: (-len(a), a)):
        by_first.setdefault(alias[0], []).append(re.escape(alias[1:]))
    groups = [re.escape(first) + "(?:" + "|".join(rest) + ")" for first, rest in by_first.items()]
    return f"(?i)(?<!{TOKEN_CHARS})(?:{'|'.join(groups)})(?!{TOKEN_CHARS})"


def extract_skills(text: Column | str, lexicon: Sequence[Skill]) -> Column:
    """Sorted distinct canonical skills whose aliases stand in the raw text."""
    text = F.col(text) if isinstance(text, str) else text
    if not lexicon:
        return F.array().cast("array<string>")
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(alias_pattern(lexicon)), 0)
    found = F.array_distinct(F.transform(hits, lambda h: F.lower(h)))
    renamed = {a: c for a, c in _alias_map(lexicon).items() if a != c}
    if renamed:
        table = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
        found = F.array_distinct(F.transform(found, lambda a: F.coalesce(F.element_at(table, a), a)))
    return F.array_sort(found)


def skill_domains(df: DataFrame, lexicon: Sequence[Skill], skill: str = "skill") -> DataFrame:
    """Attach the sorted ``domains`` of each skill (empty when unknown)."""
    pairs = sorted({(s.canonical, s.domain) for s in lexicon})
    spark = df.sparkSession
    table = (
        spark.createDataFrame(pairs, "canonical string, domain string")
        .groupBy(F.col("canonical").alias(skill))
        .agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    )
    return df.join(table, skill, "left").withColumn(
        "domains", F.coalesce("domains", F.array().cast("array<string>"))
    )
