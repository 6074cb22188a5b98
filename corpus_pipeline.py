"""From raw documents to token ids: toxicity, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, decontam, linededup, simhash, toxicity
from foliospark.llm.common import drop_tree, fresh_path, table
from foliospark.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one equals or nearly equals."""
    return linededup.drop_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of benchmark passages."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte BPE", encode),
]

#: Models and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table of documents. Each stage's result is a table in the shared folder that goes when
    the next one is written; the last one's input stays, for the rows returned come from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_tree(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
