"""From recognised text to staging rows: guard, extraction, fusion, reconciliation, mapping; and the batch over an inbox."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import digits, strip
from ..functions.replies import json_text, reply_failed
from ..operators import cases as case_ops
from ..operators import mapper, merge, review
from ..operators.reconcile import reconcile
from ..sources.session import settled
from .certificate import add_record

#: Characters of text below which nothing is extracted.
LEAST_TEXT = 10
#: A note for documents without text enough.
NO_TEXT = "texto insuficiente"

#: An extractor adds a record to rows with a text.
Extractor = Callable[[DataFrame], DataFrame]


def rule_extractor(lexicon: Iterable[str] = ()) -> Extractor:
    words = list(lexicon)
    return lambda df: add_record(df, "text", "record", words)


def _model_record(reply: Column) -> Column:
    """A record from a model's reply: its sections by name, values of other types cast or dropped."""
    text = json_text(reply)
    values = {}
    for section, fields in schema.SECTIONS.items():
        for field, kind in (f.split() for f in fields.split(", ")):
            raw = F.nullif(F.get_json_object(text, f"$.{section}.{field}"), F.lit(""))
            values[f"{section}.{field}"] = raw if kind == "string" else F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date")) if kind == "date" else raw.try_cast(kind)
    return schema.record(values)


def hybrid_extractor(reply: str, lexicon: Iterable[str] = ()) -> Extractor:
    """Rules fused with a model's replies in a column; rules alone where there is no good reply."""
    rules = add_record

    def run(df: DataFrame) -> DataFrame:
        own = rules(df, "text", "__rule", list(lexicon))
        own = own.withColumns({"__model": _model_record(F.col(reply)), "__failed": F.coalesce(reply_failed(F.col(reply)), F.lit(True))})
        return merge.merge(own, "__rule", "__model", F.col("__failed"), F.col("text")).drop("__rule", "__model", "__failed")

    return run


def model_extractor(reply: str) -> Extractor:
    return lambda df: df.withColumn("record", _model_record(F.col(reply)))


EXTRACTORS = {"rule": rule_extractor, "hibrido": hybrid_extractor, "ollama": model_extractor}


def extractor_named(name: str, reply: str | None = None, lexicon: Iterable[str] = ()) -> Extractor:
    """The extractor of a name; rules for unknown names and where there are no replies."""
    if name == "hibrido" and reply:
        return hybrid_extractor(reply, lexicon)
    if name == "ollama" and reply:
        return model_extractor(reply)
    return rule_extractor(lexicon)


def reconcile_record(df: DataFrame, name: str = "record") -> DataFrame:
    """The record's dates and days put right."""
    part = lambda f: F.col(f"{name}.incapacidad.{f}")
    df = df.withColumns({"__start": part("fecha_inicio"), "__end": part("fecha_fin"), "__days": part("dias"), "__held": part("inicio_anclada")})
    df = reconcile(df, "__start", "__end", "__days", F.col("__held"), "__calc")
    new = {"fecha_inicio": "__start", "fecha_fin": "__end", "dias": "__days", "fecha_inicio_calculada": "__calc"}
    values = {"tipo_documento": F.col(f"{name}.tipo_documento")}
    for section, fields in schema.SECTIONS.items():
        for field in (f.split()[0] for f in fields.split(", ")):
            values[f"{section}.{field}"] = F.col(new[field]) if section == "incapacidad" and field in new else F.col(f"{name}.{section}.{field}")
    values["incapacidad.inicio_anclada"] = F.lit(None)
    return df.withColumn(name, schema.record(values)).drop("__start", "__end", "__days", "__held", "__calc")


def extract(df: DataFrame, extractor: Extractor | None = None, least: int = LEAST_TEXT) -> DataFrame:
    """df (text and others) with record and note, in one pass. Texts under `least` characters get an empty record and a note;
    the extractor sees none of them, but a null text in their place."""
    enough = F.length(strip(F.coalesce(F.col("text"), F.lit("")))) >= least
    shown = df.withColumn("__enough", enough).withColumn("__text", F.col("text")).withColumn("text", F.when(F.col("__enough"), F.col("text")))
    done = reconcile_record((extractor or rule_extractor())(shown)).withColumn("text", F.col("__text"))
    return done.withColumns(
        {
            "record": F.when(F.col("__enough"), F.col("record")).otherwise(schema.empty_record()),
            "note": F.when(~F.col("__enough"), F.lit(NO_TEXT)),
        }
    ).drop("__enough", "__text")


def process_cases(
    files: DataFrame, texts: DataFrame, dims: dict[str, DataFrame], today: date, extractor: Extractor | None = None,
    limit: int | None = 500, names: tuple[str, str] = ("stub", "rule-based"),
) -> tuple[DataFrame, DataFrame]:
    """(one row per case, misnamed files) for the files of an inbox (path, channel) and the texts of documents (path, text,
    error). Cases beyond limit wait for the next run; a case whose base document failed keeps its error and nothing else."""
    good, stray = case_ops.split_names(case_ops.parse_names(files))
    rows = case_ops.cases(good)
    if limit is not None:
        rows = case_ops.first_cases(rows, limit)
    own = texts.withColumnRenamed("path", "__path")  # path, text, error, and what the extractor asks for
    rows = rows.join(own, F.col("base") == F.col("__path"), "left").drop("__path")
    # settled, since the mapping looks rows up on two ways and neither engine nor rules should run for each
    done = settled(extract(rows, extractor).withColumn("note", F.when(F.col("base").isNotNull(), F.col("note"))))
    read = F.nullif(F.col("record.paciente.documento_numero"), F.lit(""))
    done = done.withColumns(
        {
            "o_cedula": F.when(read.isNull(), F.col("case_id")),
            "source": F.element_at(F.split(F.coalesce("base", "first_path"), "/"), -1),
            "ocr_backend": F.lit(names[0]),
            "extractor": F.lit(names[1]),
        }
    )
    mapped = mapper.map_to_staging(done, dims, today)
    seen = F.nullif(digits(read), F.lit(""))
    clash = F.when(seen != F.col("case_id"), F.concat(F.lit("Cédula del nombre ("), F.col("case_id"), F.lit(") ≠ leída ("), seen, F.lit(")")))
    many = F.when(
        F.col("n_base") > 1,
        F.concat(F.lit("Hay "), F.col("n_base").cast("string"), F.lit(" documentos base para la cédula "), F.col("case_id"), F.lit(" (¿trámites distintos?): revisar")),
    )
    problems = F.concat("problems", mapper.present_list(clash, many))
    mapped = mapped.withColumn("problems", problems).withColumns(
        {
            "problemas": F.nullif(F.array_join("problems", "; "), F.lit("")),
            "needs_review": F.size("problems") > 0,
            "failed": F.col("error").isNotNull(),
        }
    )
    # staging rows, alerts, routes and counters all come from this one result
    return settled(mapped.withColumn("complete", (F.col("documents") == "COMPLETA") & ~F.col("needs_review"))), stray


def staged(mapped: DataFrame) -> DataFrame:
    """Staging rows with ids that case, source and start decide."""
    rows = mapped.where(~F.col("failed")).withColumn("case_start", F.col("start"))
    rows = review.add_ids(rows, ["case_id", "archivo_origen", "case_start"])
    return rows.select("id", *schema.STAGING_COLUMNS, "case_id", "channel")
