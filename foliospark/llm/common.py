"""What the text operators share: tables, checkpoints, slices of Arrow batches, bounded samples."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python: long texts must not pile up in a worker.
ARROW_ROWS = 1000
#: Makes plans made while it holds drop their shuffle files when they have run.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows handled at once inside a Python worker.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the Arrow batches that go to Python workers from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster: spark.checkpoint.dir. Where that is unset, a folder of this machine in local mode, as in
    tests; on a cluster an error, since executors don't see each other's folders."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there, so that a lost executor costs no recomputation. What
    the plan shuffled for it goes once it is written, where this Spark can do that."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


@contextlib.contextmanager
def stored(df: DataFrame, what: str, plain: str):
    """df as a table in the shared folder for as long as the block runs; what leaves the block must not read it any more.
    plain: a column of values that hardly repeat, for which no dictionary is tried."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
        out.option(f"parquet.enable.dictionary#{plain}", "false").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    try:
        yield spark.read.parquet(path)
    finally:
        drop_tree(spark, path)


def id_text(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3 (a null id counts as the empty text)."""
    return F.crc32(id_text(doc_id).cast("binary")) % 3 == 1


def slices(batches, rows: int = SLICE_ROWS):
    """The Arrow batches in pieces of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls empty) and the n + 1 offsets of its rows in them."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def sample_ids(rows: DataFrame, label: str, doc_id: str, per_class: int, values: list) -> dict:
    """At most per_class ids of each of a few label values, the least by a hash of the id: {label: [ids]}.

    Only ids and labels move. Each value's ids come from a top-k query: every task keeps its least per_class and no more
    come together, so a label that most rows have is gathered nowhere.
    """
    ids = rows.select(F.col(label).alias("__label"), F.col(doc_id).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    out = {}
    for value in values:
        found = ids.where(F.col("__label") == F.lit(value)).select("__id").orderBy(F.xxhash64("__id"), "__id").limit(per_class).collect()
        if found:
            out[value] = [r["__id"] for r in found]
    return out


def texts_by_id(docs: DataFrame, lists: list[list], max_bytes: int) -> list[dict]:
    """{doc_id: text} of each of a few bounded lists of ids, in their order. A text that would take its list beyond max_bytes
    is left out; where that leaves a list no text, the least one stays."""
    ids = list({i: None for own in lists for i in own})
    if not ids:
        return [{} for _ in lists]
    got = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text").toLocalIterator()
    texts = {r["doc_id"]: r["text"] or "" for r in got}
    size = {i: len(t.encode("utf-8", "surrogatepass")) for i, t in texts.items()}
    out = []
    for own in lists:
        kept, used = {}, 0
        for i in own:
            if used + size.get(i, 0) <= max_bytes:
                kept[i] = texts.get(i, "")
                used += size.get(i, 0)
        some = [i for i in own if size.get(i)]
        if some and not used:
            least = min(some, key=size.get)
            kept[least] = texts[least]
        out.append(kept)
    return out


def drop_tree(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


