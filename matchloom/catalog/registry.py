"""The registry and what the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchloom.functions.skills import Skill
from matchloom.functions.text import STOP_WORDS
from matchloom.operators.layout import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL oracle when SQL can express it."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table, dealt out over the cores when it is one small file."""
    return spread(table(spark, sf_dir, name))


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def join_text(array: Column | str) -> Column:
    return F.array_join(array, "|")


# Test parameters: the driver's texts are invented prose, so lexicon and families are common words.
WORDS = {
    "en": ("the", "and", "of", "for", "that"),
    "fr": ("les", "des", "que", "dans"),
    "de": ("der", "und", "die", "das"),
    "es": ("los", "las", "del", "con"),
}
LEXICON = tuple(Skill(w, domain, (w,)) for domain, words in WORDS.items() for w in words)
ALL_WORDS = [s.canonical for s in LEXICON]


# SQL fragments ---------------------------------------------------------------------------------

_SQL_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_SQL_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_normalize(x: str) -> str:
    tags = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    return f"lower(trim(regexp_replace({tags}, '[^0-9A-Za-z]+', ' ', 'g')))"


def sql_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_SQL_BLANK}+|{_SQL_BLANK}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SQL_BLANK}+', ' ', 'g'))"


def sql_explain_normalize(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9+#./\-]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    found = f"regexp_extract_all({sql_explain_normalize(x)}, '[a-z0-9][a-z0-9+#./-]*')"
    return f"list_filter({found}, lambda t: length(t) > 1 AND NOT list_contains({_SQL_STOP}, t))"


def sql_skills(x: str) -> str:
    """Distinct lexicon words standing in the text, sorted."""
    hits = ", ".join(
        f"CASE WHEN regexp_matches(lower({x}), '(^|[^a-z0-9+#]){w}($|[^a-z0-9+#])') THEN '{w}' END" for w in ALL_WORDS
    )
    return f"list_sort(list_filter([{hits}], lambda s: s IS NOT NULL))"


def sql_digest(x: str) -> str:
    return f"substring(sha256({sql_squeeze(x)}), 1, 16)"
