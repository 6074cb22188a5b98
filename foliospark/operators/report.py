"""Accuracy of extraction against known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agrees(value: Column, truth: Column) -> Column:
    """Whether a value holds the truth or is held by it, without case; null truth isn't scored, a null value is wrong."""
    a, b = F.lower(value.cast("string")), F.lower(truth.cast("string"))
    hit = (a != "") & (F.contains(a, b) | F.contains(b, a))
    return F.when(truth.isNotNull(), F.coalesce(hit, F.lit(False)))


def agrees_with_any(value: Column, truths: Column) -> Column:
    return F.when(truths.isNotNull(), F.coalesce(F.array_contains(truths, value), F.lit(False)))


def accuracy(scored: DataFrame, fields: list[str], key: str | None = None) -> DataFrame:
    """hits, scored and percent over boolean columns (null: not scored), by key or in all."""
    hits = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in fields), F.lit(0))
    counted = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    rows = scored.groupBy(key) if key else scored.groupBy()
    out = rows.agg(F.sum(hits).alias("hits"), F.sum(counted).alias("scored"))
    return out.withColumn("percent", F.when(F.col("scored") > 0, F.round(100 * F.col("hits") / F.col("scored"), 0)))
