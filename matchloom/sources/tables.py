"""Parquet tables: corpora, IDF weights, stored vectors."""

from __future__ import annotations

import posixpath
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a cleaned corpus; ``partition_by='job_family'`` lets a family filter prune directories.

    Rows are rebalanced by the partition column first: small families share tasks and get one file each, a family that
    holds most rows is cut into tasks of the advisory size, so there are about size / target files and not tasks x
    families.
    """
    if partition_by is None:
        write_table(df, path)
    else:
        write_table(df.hint("rebalance", F.col(partition_by)), path, [partition_by])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def write_idf(idf: DataFrame, path: str) -> None:
    write_table(idf.select("term", "df", "idf"), path)


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, df long, idf double").parquet(path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Add vectors to the store; ``vectors(model, text_hash, embedding)``. What the store holds already
    is left out, so a repeated job changes nothing. One writer at a time."""
    new = vectors.select("model", "text_hash", "embedding").dropDuplicates(["model", "text_hash"])
    if _exists(vectors.sparkSession, path):
        known = read_vectors(vectors.sparkSession, path).select("model", "text_hash")
        new = new.join(known, ["model", "text_hash"], "left_anti")
    new.write.mode("append").partitionBy("model").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text_hash string, embedding array<float>, model string").parquet(path)


def shared_root(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own; a cluster must name one all executors can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = spark.sparkContext.getCheckpointDir()
        if folder is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-"))
            folder = spark.sparkContext.getCheckpointDir()
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables under ``shared_root``."""
    return posixpath.join(shared_root(spark), name)
