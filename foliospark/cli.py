"""Command line: a folder of documents to staging rows, once; their recognised text only; or the record of one document."""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cases
from .plans import pipeline
from .sources import catalog, inbox, pages, render
from .sources.session import spread

#: Names of the extractors in staging rows.
NAMES = {"rule": "rule-based", "hibrido": "hibrido", "ollama": "ollama"}


def texts_of(spark: SparkSession, root: str, files: DataFrame, engine: str) -> DataFrame:
    """path, text, error of the files named (path, full_path); only they are opened."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("__p"), "content")
    opened = files.join(content, F.col("full_path") == F.col("__p")).select(F.col("path").alias("doc_id"), F.col("path").alias("name"), "content")
    return pages.document_text(pages.recognise(render.render(spread(opened)), engine)).withColumnRenamed("doc_id", "path")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("inbox")
    parser.add_argument("--out", help="Parquet folder of staging rows, or of texts with --text-only; without it nothing is written")
    parser.add_argument("--dry-run", action="store_true", help="count and write nothing, whatever --out says")
    parser.add_argument("--database", help="database of the reference tables")
    parser.add_argument("--engine", default="stub")
    parser.add_argument("--extractor", default="rule", choices=sorted(NAMES))
    parser.add_argument("--replies", help="Parquet table of a model's replies (path, reply) for the extractors that use one")
    parser.add_argument("--text-only", action="store_true", help="recognised texts: written to --out, or as many as --limit returned")
    parser.add_argument("--json", metavar="PATH", help="the record of one document of the inbox")
    parser.add_argument("--limit", type=int, default=500)
    own = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("foliospark").getOrCreate()
    files = inbox.read_inbox(spark, own.inbox)
    parsed = cases.parse_names(files)
    if own.json:
        text = texts_of(spark, own.inbox, files.where(F.col("path") == own.json), own.engine)
        found = pipeline.extract(text, pipeline.rule_extractor()).first()
        return found.asDict(recursive=True) if found else {}
    # the batch is chosen by names alone, so that no document beyond it is opened or recognised
    batch = cases.first_cases(cases.cases(parsed), own.limit).where(F.col("base").isNotNull()).select(F.col("base").alias("path"))
    texts = texts_of(spark, own.inbox, parsed.join(batch, "path", "left_semi"), own.engine)
    if own.text_only:
        if own.out and not own.dry_run:
            texts.write.mode("overwrite").parquet(own.out)
            return {"texts": spark.read.parquet(own.out).count()}
        return {r["path"]: r["text"] for r in texts.limit(own.limit).toLocalIterator()}
    dims, there = catalog.dims_or_empty(spark, lambda: catalog.dims_of_tables(spark, own.database) if own.database else catalog.empty_dims(spark))
    reply, name = None, "rule"
    if own.replies and own.extractor != "rule":
        texts = texts.join(spark.read.parquet(own.replies).select("path", "reply"), "path", "left")
        reply, name = "reply", own.extractor
    extractor = pipeline.extractor_named(name, reply)
    mapped, stray = pipeline.process_cases(files, texts, dims, date.today(), extractor, own.limit, (own.engine, NAMES[name]))
    if own.out and not own.dry_run:
        from .streaming.intake import append_new

        append_new(pipeline.staged(mapped), own.out)
    return cases.run_summary(mapped, stray, F.col("complete"), F.col("failed")).first().asDict() | {"catalogue": there}


if __name__ == "__main__":
    print(json.dumps(main(), ensure_ascii=False, default=str))
