"""CSV source whose headers are resolved through ordered alias lists."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

Aliases = Mapping[str, Sequence[str]]

# Accepted headers per target column, first present alias wins.
POSTING_ALIASES: dict[str, tuple[str, ...]] = {
    "job_id": ("job_id", "id", "jobid"),
    "title": ("title", "job_title", "position", "role"),
    "description": ("description", "job_description", "summary", "job_summary"),
    "skills": ("skills_desc", "skills", "job_skills"),
}
RESUME_ALIASES: dict[str, tuple[str, ...]] = {
    "resume_id": ("resume_id", "id", "candidate_id"),
    "category": ("category", "role", "resume_category"),
    "resume_text": ("resume_str", "resume", "text", "resume_html"),
}

# Cell texts that count as missing (the defaults of pandas' CSV reader).
MISSING = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def resolve_columns(header: Sequence[str], aliases: Aliases) -> dict[str, int]:
    """Target column -> position in the header. Of headers equal but for case the last one counts."""
    position = {name.lower(): i for i, name in enumerate(header)}
    resolved = {}
    for target, names in aliases.items():
        present = [n.lower() for n in names if n.lower() in position]
        if present:
            resolved[target] = position[present[0]]
    return resolved


def read_aliased_csv(
    spark: SparkSession, path: str, aliases: Aliases, multi_line: bool = True, placed: bool = False
) -> DataFrame:
    """Read only the columns named by ``aliases``, as strings under their target names.

    Every file's own header counts: files are grouped by header, each group is read with its columns
    bound by position (so unused ones are pruned by the CSV reader), and the groups are put together;
    a column that a group lacks is null there. Files without an expected column are refused.
    ``multi_line=False`` keeps files splittable; use it for corpora whose cells hold no line breaks. ``placed`` adds
    ``_file, _block``, by which ``with_ingest_order`` numbers rows over all files.
    """
    groups = _headers(spark, path)
    frames = []
    for header, files in sorted(groups.items()):
        resolved = resolve_columns(header, aliases)
        if not resolved:
            raise ValueError(f"no expected column in the header of {files[0]}")
        schema = ", ".join(f"c{i} string" for i in range(len(header)))
        reader = spark.read.option("multiLine", multi_line).option("escape", '"').option("quote", '"')
        rows = reader.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
        frames.append(
            rows.select(
                *[F.when(~F.col(f"c{i}").isin(*MISSING), F.col(f"c{i}")).alias(t) for t, i in resolved.items()],
                *([F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")] if placed else []),
            )
        )
    if not frames:
        raise ValueError(f"no expected column in the header of {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by the columns of their first line: one short line per file comes to the driver."""
    lines = spark.read.option("wholetext", False).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )
    place = F.monotonically_increasing_id()
    first = lines.filter("at = 0").withColumn("place", place).groupBy("file").agg(F.min_by("value", "place").alias("line"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():
        header = next(csv.reader([row.line.removeprefix("\ufeff")]), [])
        groups.setdefault(tuple(header), []).append(unquote(row.file))
    return groups
