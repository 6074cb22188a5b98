"""Fusion of the rules' record with a language model's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import clean_origin
from ..functions.dates import dates_in
from ..schema import SECTIONS, record

#: Fields where the rules come first; elsewhere the model does.
RULES_FIRST = {("paciente", "documento_numero"), ("paciente", "documento_tipo")}
DATES = ("fecha_inicio", "fecha_fin", "fecha_expedicion")


def _or(kind: str, first: Column, second: Column) -> Column:
    """first unless it is empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second) if kind == "string" else F.coalesce(first, second)


def merged(rule: str, model: str, text: Column, held: Column) -> Column:
    """The record fused from two record columns; held are the dates of the text.

    Identity numbers come from the rules if there, all else from the model if there. A date counts only if the text holds
    it (if there is a text); the start comes from the rules if it is anchored to its label, and then the days too. The
    kind of document and what its rules alone know (the permit's section) stay the rules'.
    """
    some = F.coalesce(F.length(text) > 0, F.lit(False))
    values: dict[str, Column] = {"tipo_documento": F.col(f"{rule}.tipo_documento")}
    for section, fields in SECTIONS.items():
        for field, kind in (f.split() for f in fields.split(", ")):
            name = f"{section}.{field}"
            a, b = F.col(f"{rule}.{name}"), F.col(f"{model}.{name}")
            values[name] = _or(kind, a, b) if (section, field) in RULES_FIRST else _or(kind, b, a)
    anchored = F.coalesce(F.col(f"{rule}.incapacidad.inicio_anclada"), F.lit(False))

    def grounded(*candidates: Column) -> Column:
        return F.coalesce(*[F.when(~some | F.array_contains(held, c), c) for c in candidates])

    for field in DATES:
        name = f"incapacidad.{field}"
        values[name] = grounded(F.col(f"{model}.{name}"), F.col(f"{rule}.{name}"))
    rule_start, rule_days = F.col(f"{rule}.incapacidad.fecha_inicio"), F.col(f"{rule}.incapacidad.dias")
    values["incapacidad.fecha_inicio"] = F.when(anchored, rule_start).otherwise(values["incapacidad.fecha_inicio"])
    values["incapacidad.dias"] = F.when(anchored & rule_days.isNotNull(), rule_days).otherwise(values["incapacidad.dias"])
    values["incapacidad.origen"] = F.coalesce(clean_origin(values["incapacidad.origen"]), clean_origin(F.col(f"{rule}.incapacidad.origen")))
    values["incapacidad.inicio_anclada"] = anchored
    values["incapacidad.fecha_inicio_calculada"] = F.lit(None)
    return record(values)


def merge(df: DataFrame, rule: str, model: str, failed: Column, text: Column, out: str = "record") -> DataFrame:
    """The fused record, or the rules' alone for permits and where the model failed."""
    alone = F.coalesce(failed, F.lit(True)) | (F.col(f"{rule}.tipo_documento") == "permiso")
    dated = df.withColumn("__dates", dates_in(text))
    return dated.withColumn(out, F.when(alone, F.col(rule)).otherwise(merged(rule, model, text, F.col("__dates")))).drop("__dates")
