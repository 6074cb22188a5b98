"""Rows as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates and times as ISO texts."""
    forms = {DateType: "yyyy-MM-dd", TimestampType: "yyyy-MM-dd'T'HH:mm:ss"}
    return df.select(*[F.date_format(f"`{f.name}`", forms[type(f.dataType)]).alias(f.name) if type(f.dataType) in forms else F.col(f"`{f.name}`") for f in df.schema.fields])


def as_json(*columns: str | Column) -> Column:
    """An object of the columns; nulls stay, letters beyond ASCII too."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_rows(df: DataFrame) -> DataFrame:
    """One text per row."""
    return iso_dates(df).select(as_json("*").alias("value"))
