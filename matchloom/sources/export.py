"""Result export: JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.functions.scores import one_decimal, to_percent
from matchloom.functions.text import family_label

# The header of the exported Markdown table.
MARKDOWN_HEADER = (
    "| Rank | Job title | Family | Relevance | Semantic match |",
    "|---|---|---|---|---|",
)


def markdown_rows(
    df: DataFrame,
    rank: str = "rank",
    title: str = "job_title",
    family: str = "job_family",
    relevance: str = "cross_encoder_probability",
    semantic: str = "bi_encoder",
) -> DataFrame:
    """Add ``line``: the row as a Markdown table line."""
    cell = F.regexp_replace(F.replace(F.col(title), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")
    return df.withColumn(
        "line",
        F.concat(
            F.lit("| "),
            F.concat_ws(
                " | ",
                F.col(rank).cast("string"),
                cell,
                family_label(family),
                F.concat(one_decimal(to_percent(relevance)), F.lit("%")),
                F.concat(one_decimal(to_percent(semantic)), F.lit("%")),
            ),
            F.lit(" |"),
        ),
    )


def markdown_tables(lines: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """``by, document``: the whole Markdown table of each query, header and divider first. A query has no
    more lines than the ``top_n`` it asked for."""
    tables = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), "line"))).alias("_rows"))
    header = F.array(*map(F.lit, MARKDOWN_HEADER))
    return tables.select(by, F.array_join(F.concat(header, F.col("_rows.line")), "\n").alias("document"))


def write_markdown(lines: DataFrame, path: str, by: str = "query_id", rank: str = "rank", buckets: int = 64) -> None:
    """Markdown text in ``buckets`` folders by hash of the query, so that millions of queries make no
    more folders than that. Each table follows a comment line that names its query."""
    named = F.concat(F.lit("<!-- "), F.col(by).cast("string"), F.lit(" -->\n"), F.col("document"), F.lit("\n"))
    tables = markdown_tables(lines, by, rank).withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)))
    tables.select("bucket", named.alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
