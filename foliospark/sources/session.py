"""The session's shared folder, and plans cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of this machine in local mode, as in tests; on a cluster an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: later branches neither repeat its plan nor its work, and a lost
    executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least, for work that costs much a row over a table of few files. Tables
    of more partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
