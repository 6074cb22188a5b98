"""Files of an inbox as rows; contents are read only where a column asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cases import inbox_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, r"^.*?" + _quoted(root.rstrip("/")) + "/", "")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_inbox(spark: SparkSession, root: str) -> DataFrame:
    """path (under the inbox), full_path, modified, size, channel of every file to take in; none if there is no inbox."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "path string, full_path string, modified timestamp, size bigint, channel string")
    return listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root)


def listed(files: DataFrame, root: str) -> DataFrame:
    rows = files.select(
        relative(F.col("path"), root).alias("path"), F.col("path").alias("full_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")
    )
    return inbox_files(rows)


def upload_reason(suffix_ok: Column, size: Column, most: int) -> Column:
    """Why an upload is refused: 415 for its type, 413 for its size, 400 if it is empty; null if it isn't."""
    return F.when(~suffix_ok, 415).when(size > most, 413).when(size == 0, 400)
