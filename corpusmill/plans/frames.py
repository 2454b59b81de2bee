"""What plans share: cutting lineage, and broadcasting only what has been counted."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, whose executors are in the same
    process, may do without it."""
    context = spark.sparkContext
    if root := context.getConf().get("spark.checkpoint.dir", None):
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def small_or_not(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df computed once, with a broadcast hint if it has at most so many rows; else the join is a shuffled one."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
