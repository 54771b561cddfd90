"""History imports and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.sources.schemas import IMPORT_ENTRY, REQUEST_LOG


def read_import(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per imported run: ``source, seq`` (position in its payload) and the entry's fields.

    A payload is ``{"entries": [...]}``: a file each, or with ``multi_line=False`` a line each, which
    keeps large files splittable. ``created_at`` comes as epoch milliseconds.
    """
    files = (
        spark.read.schema(f"entries array<{IMPORT_ENTRY}>")
        .option("multiLine", multi_line)
        .json(path)
        .select(F.col("_metadata.file_path").alias("source"), F.posexplode("entries").alias("seq", "entry"))
    )
    return files.select("source", "seq", "entry.*").withColumn(
        "created_at", F.timestamp_millis("created_at")
    )


def read_request_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON request lines; an unreadable line keeps its text in ``_corrupt_record``."""
    reader = spark.readStream if stream else spark.read
    return (
        reader.schema(REQUEST_LOG + ", ts timestamp, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
