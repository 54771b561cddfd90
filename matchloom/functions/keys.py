"""Digests and identity keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchloom.functions.text import normalize_text, squeeze


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def category_key(category: Column | str, unicode: bool = True) -> Column:
    """``Information technology`` -> ``INFORMATION-TECHNOLOGY``."""
    return F.upper(F.replace(normalize_text(category, unicode), F.lit(" "), F.lit("-")))


def email_key(email: Column | str) -> Column:
    return F.lower(F.trim(_col(email)))


def text_digest(text: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the squeezed text."""
    return F.substring(F.sha2(squeeze(text), 256), 1, 16)


def text_hash(text: Column | str, model: str) -> Column:
    """Identity of a stored vector: model name and squeezed text."""
    return F.sha2(F.concat_ws("\0", F.lit(model), squeeze(text)), 256)


def _json_char(ch: Column) -> Column:
    code = F.ascii(ch)
    wide = code > 0xFFFF
    offset = code - 0x10000
    pair = F.format_string(
        "\\u%04x\\u%04x",
        (F.lit(0xD800) + F.shiftright(offset, 10)).cast("int"),
        (F.lit(0xDC00) + F.pmod(offset, F.lit(1024))).cast("int"),
    )
    return (
        F.when(ch == '"', F.lit('\\"'))
        .when(ch == "\\", F.lit("\\\\"))
        .when(ch == "\n", F.lit("\\n"))
        .when(ch == "\r", F.lit("\\r"))
        .when(ch == "\t", F.lit("\\t"))
        .when(ch == "\b", F.lit("\\b"))
        .when(ch == "\f", F.lit("\\f"))
        .when(wide, pair)
        .when((code < 32) | (code > 126), F.format_string("\\u%04x", code.cast("int")))
        .otherwise(ch)
    )


def json_string(text: Column | str) -> Column:
    """JSON string literal with every non-ASCII character escaped."""
    text = _col(text)
    plain = text.rlike(r'^[\x20-\x7E&&[^"\\]]*$')
    escaped = F.array_join(F.transform(F.split(text, ""), _json_char), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def json_fraction(number: Column | str) -> Column:
    """Shortest decimal text of a double in [0, 1]: ``0.5``, ``1.0``, ``0.0001``, ``1e-05``."""
    number = _col(number).cast("double")
    java = number.cast("string")
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E-"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(java, F.lit("E-"), F.lit(2)).try_cast("int")
    small = F.when(
        exponent == 4, F.concat(F.lit("0.000"), F.replace(mantissa, F.lit("."), F.lit("")))
    ).otherwise(F.concat(mantissa, F.lit("e-"), F.lpad(exponent.cast("string"), 2, "0")))
    return F.when(number == 0, F.lit("0.0")).when(number >= 0.001, java).otherwise(small)


def filters_digest(families: Column | str, min_score: Column | str, present: Column | bool = True) -> Column:
    """Eight hex digits identifying a filter setting. Family order matters.

    An absent filter object hashes ``{}``; a present one with both fields null does not.
    """
    families, min_score = _col(families), _col(min_score)
    present = F.lit(present) if isinstance(present, bool) else present
    listed = F.concat(F.lit("["), F.array_join(F.transform(families, json_string), ", "), F.lit("]"))
    body = F.concat(
        F.lit('{"job_families": '),
        F.coalesce(listed, F.lit("null")),
        F.lit(', "min_score": '),
        F.coalesce(json_fraction(min_score), F.lit("null")),
        F.lit("}"),
    )
    return F.substring(F.sha2(F.when(present, body).otherwise(F.lit("{}")), 256), 1, 8)


def request_key(digest: Column, top_k: Column, top_n: Column, filters: Column, explain: Column) -> Column:
    """Identity of a match request; requests with equal keys have equal results."""
    return F.concat_ws(
        ":",
        F.lit("match"),
        F.lit("v1"),
        digest,
        top_k.cast("string"),
        top_n.cast("string"),
        filters,
        explain.cast("int").cast("string"),
    )
