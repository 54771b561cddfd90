"""Physical layout: cutting lineage on shared storage, dealing out small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matchloom.sources.tables import shared_root


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Deal rows out evenly when the input has fewer splits than the cluster has cores.

    Text expressions cost far more than moving the text once, and one small file would keep a single
    core busy. An input with enough splits stays as it is, without a shuffle. ``scan`` is the plain
    scan ``df`` was made from; only its splits are counted, nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = (df if scan is None else scan).rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df
