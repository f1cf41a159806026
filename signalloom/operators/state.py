"""Where intermediate results live between rounds of an iterative job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder.  A new one only in local mode, where all tasks see it."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="signalloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends here and the rows survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that later steps may use freely.

    A generator evaluates them exactly once per row.  Plain projections would be
    merged into, and filters pushed below, each other, which repeats a costly regex
    for every mention of its result.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
