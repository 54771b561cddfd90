"""Text clean-up, tokenising, caps and highlighting as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text caps (characters) and the token pattern.
SCORING_TEXT_CHARS = 1200
RESULT_DESCRIPTION_CHARS = 1200
HISTORY_DESCRIPTION_CHARS = 400
LABEL_CHARS = 50
TOKEN_PATTERN = "[a-z0-9][a-z0-9+#./-]+"  # at least two characters

# The stop list of the explanation tokenizer.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "at", "by", "from", "is",
    "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "as", "it", "its", "we",
    "you", "your", "our", "their", "his", "her", "he", "she", "they", "i", "will", "would", "can", "could",
    "should", "may", "might", "must", "shall", "have", "has", "had", "do", "does", "did", "not", "no", "so",
    "if", "then", "than", "also", "into", "about", "over", "under", "after", "before", "between", "during",
    "through", "up", "down", "out", "all", "any", "each", "other", "more", "most", "some", "such", "only",
    "own", "same",
)

# Java's (?U)\s is Unicode White_Space; Python also splits on the four separators 0x1c-0x1f.
_BLANK = r"[\s\x1c-\x1f]"


@F.arrow_udf(T.StringType())
def _nfkc_batch(values: pa.Array) -> pa.Array:
    # pyarrow's own utf8_normalize leaves the composed forms decomposed, so it can't be used here
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nfkc(text: Column | str) -> Column:
    """NFKC form. Only rows with a non-ASCII character cross over to Python."""
    text = _col(text)
    needs_python = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc_batch(F.when(needs_python, text)), text)


def normalize_text(text: Column | str, unicode: bool = True) -> Column:
    """Tags and every run of non-alphanumerics become one space; trimmed, lower case; null is ''.

    ``unicode=False`` skips the compatibility fold, which keeps the expression JVM-only.
    """
    text = F.coalesce(_col(text).cast("string"), F.lit(""))
    if unicode:
        text = nfkc(text)
    no_tags = F.regexp_replace(text, "<[^>]+>", " ")
    # ASCII-only POSIX class: the same set as [^0-9A-Za-z], and twice as fast in Java's matcher
    return F.lower(F.trim(F.regexp_replace(no_tags, r"\P{Alnum}+", " ")))


def join_parts(*parts: Column | str) -> Column:
    """Non-empty parts joined by one space (parts are already normalised)."""
    return F.concat_ws(" ", F.filter(F.array(*[_col(p) for p in parts]), lambda p: p != ""))


def combine_text(*parts: Column | str, unicode: bool = True) -> Column:
    return join_parts(*[normalize_text(p, unicode) for p in parts])


def strip(text: Column | str) -> Column:
    """Drop leading and trailing Unicode whitespace; null becomes ''."""
    return F.regexp_replace(
        F.coalesce(_col(text).cast("string"), F.lit("")), rf"(?U)\A{_BLANK}+|{_BLANK}+\z", ""
    )


def clean_text(df: DataFrame, name: str) -> DataFrame:
    """Make ``name`` a stripped, non-null string column; add it empty when absent."""
    return df.withColumn(name, strip(name) if name in df.columns else F.lit(""))


def squeeze(text: Column | str) -> Column:
    """Every run of Unicode whitespace becomes one space; no leading or trailing space."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"(?U){_BLANK}+", " "))


def is_blank(text: Column | str) -> Column:
    """True for null and for whitespace only; stops at the first visible character."""
    return F.coalesce(~_col(text).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def explain_normalize(text: Column | str) -> Column:
    """Lower case; keep ``a-z 0-9 + # . / -``; everything else becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^a-z0-9+#./\-]+", " "))


def tokens(text: Column | str, stop_words: list[str] | None = None) -> Column:
    """Tokens of raw text, in order and with repeats. Use ``array_distinct`` for the vocabulary.

    Characters ``explain_normalize`` would blank out cannot be part of a token, so the raw text is
    matched directly and that pass is saved.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def token_counts(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Term frequencies per ``by`` key."""
    return (
        df.select(*by, F.explode(tokens(text)).alias("term"))
        .groupBy(*by, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def cap(text: Column | str, n: int | None) -> Column:
    """The first ``n`` characters, the whole text when ``n`` is None."""
    return _col(text) if n is None else F.substring(_col(text), 1, n)


def family_label(family: Column | str) -> Column:
    """``INFORMATION-TECHNOLOGY`` -> ``Information Technology``; the first character stays as it is."""
    words = F.filter(F.split(_col(family), "[-_]+"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2))))), " "
    )


def derive_label(text: Column | str, n: int = LABEL_CHARS) -> Column:
    """Run label: the squeezed text, cut to ``n`` characters with an ellipsis."""
    flat = squeeze(text)
    return F.when(F.length(flat) > n, F.concat(F.rtrim(cap(flat, n)), F.lit("…"))).otherwise(flat)


def clip_results(results: Column | str, n: int = HISTORY_DESCRIPTION_CHARS) -> Column:
    """Cut the ``description`` of every struct in an array of results."""
    return F.transform(
        _col(results), lambda r: r.withField("description", F.substring(r["description"], 1, n))
    )


def embedding_text(title: Column | str, text: Column | str) -> Column:
    """What is embedded for a posting. ``text`` starts with the title, so it counts twice on purpose."""
    return squeeze(F.concat_ws(" ", F.coalesce(_col(title), F.lit("")), F.coalesce(_col(text), F.lit(""))))


def first_non_null(*cols: Column | str) -> Column:
    return F.coalesce(*[_col(c) for c in cols])


def first_non_empty(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(""))


def highlight_parts(text: Column | str, terms: Column | str) -> Column:
    """Split ``text`` around the given terms: ``array<struct<part, is_match>>``.

    Terms are matched literally, case-insensitively, longest first; blank terms are ignored.
    Parts alternate between plain text (possibly empty) and a match.
    """
    text = F.coalesce(_col(text), F.lit(""))
    kept = F.filter(F.transform(_col(terms), strip), lambda t: t != "")
    longest_first = F.array_sort(kept, lambda a, b: F.length(b) - F.length(a))
    escaped = F.transform(
        longest_first, lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    )
    pattern = F.concat(F.lit("(?iu)(?:"), F.array_join(escaped, "|"), F.lit(")"))
    none = F.array().cast("array<string>")
    hits = F.when(F.size(kept) > 0, F.regexp_extract_all(text, pattern, 0)).otherwise(none)
    between = F.when(F.size(kept) > 0, F.split(text, pattern, -1)).otherwise(F.array(text))

    def pair(part: Column, hit: Column) -> Column:
        return F.array(_part(part, False), _part(hit, True))

    parts = F.flatten(F.zip_with(between, hits, pair))
    return F.slice(parts, 1, F.size(hits) * 2 + 1)  # nothing follows the last plain part


def _part(text: Column, is_match: bool) -> Column:
    return F.struct(text.alias("part"), F.lit(is_match).alias("is_match"))
