"""Exact token totals for every context limit from a histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_tokens
from .common import cut

#: Lengths that one window task of the suffix sums holds.
BLOCK = 4096


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: how many rows have each length; counted before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct length L, read as the context limit L.

    n_docs: documents of exactly L tokens; docs_at_least: of L or more; docs_up_to: of at most L; tokens_up_to: their
    tokens; truncated_tokens: the tokens left if every document is cut to L; total_tokens, total_docs; quantile: the share
    of documents of at most L tokens. An empty histogram gives no rows. Sums run in two tiers, within blocks of lengths and
    over blocks, so no task needs all of a long histogram.
    """
    h = hist.select(
        F.col("n_tokens").cast("bigint").alias("limit_tokens"),
        F.col("n_docs").cast("bigint").alias("n_docs"),
        F.expr(f"cast(n_tokens div {block} as bigint)").alias("__b"),
    ).withColumn("__t", F.col("limit_tokens") * F.col("n_docs"))
    blocks = h.groupBy("__b").agg(F.sum("n_docs").alias("__bd"), F.sum("__t").alias("__bt"))
    over = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "__b",
        F.coalesce(F.sum("__bd").over(over), F.lit(0)).alias("__d0"),
        F.coalesce(F.sum("__bt").over(over), F.lit(0)).alias("__t0"),
        F.sum("__bd").over(everything).alias("total_docs"),
        F.sum("__bt").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("__b").orderBy("limit_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = (
        h.withColumn("__d", F.sum("n_docs").over(inside))
        .withColumn("__s", F.sum("__t").over(inside))
        .join(blocks, "__b")
        .withColumn("docs_up_to", F.col("__d0") + F.col("__d"))
        .withColumn("tokens_up_to", F.col("__t0") + F.col("__s"))
    )
    return r.select(
        "limit_tokens",
        "n_docs",
        (F.col("total_docs") - F.col("docs_up_to") + F.col("n_docs")).alias("docs_at_least"),
        "docs_up_to",
        "tokens_up_to",
        (F.col("tokens_up_to") + (F.col("total_docs") - F.col("docs_up_to")) * F.col("limit_tokens")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        (F.col("docs_up_to") / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: docs, tokens and truncated_tokens under any limit, also one that no document has as its length."""
    under = F.col("limit_tokens") <= limit
    row = sums.agg(
        F.coalesce(F.max("total_docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.max("total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max(F.when(under, F.col("docs_up_to"))), F.lit(0)).alias("d"),
        F.coalesce(F.max(F.when(under, F.col("tokens_up_to"))), F.lit(0)).alias("t"),
    )
    return row.select("docs", "tokens", (F.col("t") + (F.col("docs") - F.col("d")) * limit).alias("truncated_tokens"))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The suffix sums over the encoded lengths of every whole text of docs; a null text counts as empty (0 tokens),
    repeated rows count each, an empty table gives no rows. The histogram is written once, so that its sums don't encode again."""
    return suffix_sums(cut(histogram(count_tokens(docs, ranks_path, pattern))))
