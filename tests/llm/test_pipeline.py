"""The pipeline on the smallest tables, stage by stage against its own operators."""

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from foliospark.llm import bpe, common, decontam, simhash
from foliospark.llm.queries import RANKS

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = common.table(spark, SMALL, "documents")
    seen = {"": docs.count()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = common.fresh_path(spark, "s")
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen[name], docs = after.count(), after
    assert seen["line dedup"] == seen["toxicity"] and seen["near dedup"] < seen["line dedup"] and seen["decontamination"] <= seen["near dedup"]
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == docs.count()
    assert not decontam.contamination(docs, common.table(spark, SMALL, "benchmark")).where("contaminated").count()
    own = bpe.ByteBPE(open(RANKS, "rb").read(), P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(own.decode(np.frombuffer(r["ids"], "<u4")).decode() == texts[r["doc_id"]] for r in rows)


def odd_tables(spark, folder, rows):
    """Tables in a folder, documents with an extra column of a helper's name."""
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, removed string").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        common.table(spark, SMALL, name).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_of_odd_documents(spark, tmp_path):
    long = "\n".join(" ".join(f"w{k}x{j}" for j in range(8)) for k in range(4000))
    rows = [(1, "one two three", "en", "s", 13, None), (1, "one two three", "en", "s", 13, None), (2, None, None, None, None, "x"), (3, "", "en", None, 0, None)]
    rows += [(None, "alone and without an id", "en", "s", 23, None), (4, long, "en", "s", len(long), None), (5, long + "\nmore", "en", "s", len(long) + 5, None), (6, "\n \n", "de", "s", 3, None)]
    got = corpus_pipeline.run(spark, odd_tables(spark, tmp_path, rows)).collect()
    own = bpe.ByteBPE(open(RANKS, "rb").read(), P.PATTERN)
    texts = [(r["doc_id"], own.decode(np.frombuffer(r["ids"], "<u4")).decode()) for r in got]
    # of 5 only the new line is left, which is like no other; null, empty and blank texts are near copies of one another
    assert sorted(texts, key=str) == sorted([(1, "one two three"), (2, ""), (None, "alone and without an id"), (4, long), (5, "more")], key=str)


def test_pipeline_of_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path, [])).count() == 0
