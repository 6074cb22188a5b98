"""Draining an inbox with Structured Streaming: each run takes the files that are new and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.review import new_rows
from ..sources.inbox import FILES, listed


def stream_files(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    )
    return listed(files, root)


def append_new(rows: DataFrame, table: str) -> None:
    """Appends the rows whose id the Parquet table hasn't yet, one of each id: a batch that runs again after a failure adds
    nothing."""
    spark, rows = rows.sparkSession, rows.dropDuplicates(["id"])
    try:
        rows = new_rows(rows, spark.read.parquet(table))
    except Exception as problem:  # noqa: BLE001  only a missing table may pass
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
            raise
    rows.write.mode("append").parquet(table)


def drain(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], per_batch: int = 10_000) -> int:
    """Hands every file not seen before to handle(files, batch) and returns when there is none left; the number of batches.

    One run at a time: a second one on the same checkpoint fails to start.
    """
    count = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal count
        count += 1
        handle(batch, number)

    query = stream_files(spark, root, per_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return count
