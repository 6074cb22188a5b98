"""Extracted records to staging rows, with problems, missing fields and completeness."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import (
    DEFAULT_LEVEL,
    HOLIDAY_TYPE,
    LEVEL_LABELS,
    PERMIT_TYPES,
    RECEPTION,
    TRAFFIC_TYPE,
    TYPE_LABELS,
    default_requirements,
    lookup,
    missing_documents,
    reception,
    type_of_text,
)
from ..functions.dates import day_count, due_date, in_range, iso_date
from ..functions.text import filled, join_present
from ..schema import STAGING_COLUMNS
from . import resolve
from .reconcile import fill_in

#: Corrections that a reviewer may make.
OVERRIDES = ("cedula", "cie10", "eps", "fecha_inicio", "fecha_fin", "dias", "paciente", "tipo", "nivel", "numeroorden")
#: Fixed texts of problems.
NO_PERMIT_KIND = "No se identificó si el permiso es remunerado o no remunerado"
NO_NUMBER, NO_CODE, NO_START, NO_DAYS = (
    "No se detectó la cédula del paciente", "No se detectó el código de diagnóstico (CIE-10)", "No se detectó la fecha de inicio",
    "No se detectó el número de días",
)
NO_INSURER, NO_TRAFFIC_INSURER = "EPS no identificada en el documento", "SOAT: no se pudo determinar la EPS del empleado en el catálogo"
MISSING_DOCUMENTS = "Faltan documentos requeridos: "
#: Characters of the recognised text that the type is read from, of observations.
TYPE_TEXT, OBSERVATIONS = 2000, 500


def present_list(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def completeness(kind_has_code: Column, number: Column, code: Column, start: Column, days: Column) -> Column:
    """The share of core fields that are there: four, or three where a diagnosis doesn't apply."""
    have = lambda c: c.cast("int")
    n = have(number.isNotNull()) + have(start.isNotNull()) + have(F.coalesce(days != 0, F.lit(False)))
    share = F.when(kind_has_code, (n + have(code.isNotNull())) / F.lit(4)).otherwise(n / F.lit(3))
    return F.round(share, 3).cast("decimal(4,3)")


def observations(label: Column, code: Column, text: Column, licence: Column, issued: Column) -> Column:
    """Notes on a certificate: label, diagnosis, licence, date of issue."""
    dx = F.when(code.isNotNull(), F.concat(F.lit("DX "), code, F.coalesce(F.concat(F.lit(" - "), text), F.lit("")))).otherwise(text)
    return join_present(
        " | ", label, dx, F.concat(F.lit("Tipo licencia: "), licence), F.concat(F.lit("Exp "), issued.cast("string")), limit=OBSERVATIONS
    )


def permit_observations(label: Column, permit: str) -> Column:
    """Notes on a permit: label, company, post, detail, approver, hours, date of the request."""
    p = lambda f: F.nullif(F.col(f"{permit}.{f}").cast("string"), F.lit(""))
    told = lambda head, c: F.concat(F.lit(head), c)
    post = F.coalesce(F.concat(F.lit(" ("), p("autorizado_cargo"), F.lit(")")), F.lit(""))
    span = F.concat(F.coalesce(p("horas_desde"), F.lit("?")), F.lit("-"), F.coalesce(p("horas_hasta"), F.lit("?")))
    total = F.coalesce(F.concat(F.lit(" ("), p("horas_total"), F.lit("h)")), F.lit(""))
    hours = F.when(p("horas_total").isNotNull() | (p("horas_desde").isNotNull() & p("horas_hasta").isNotNull()), F.concat(F.lit("Horas: "), span, total))
    return join_present(
        " | ", label, told("Empresa: ", p("empresa")), told("Cargo: ", p("cargo")), told("Detalle: ", p("detalle")),
        told("Autorizado por: ", F.concat(p("autorizado_por"), post)), hours, told("Solicitado ", p("fecha_solicitud")), limit=OBSERVATIONS,
    )


def with_corrections(df: DataFrame, body: Column) -> DataFrame:
    """df with a reviewer's corrections o_<name> from a JSON object; names outside OVERRIDES and blank values don't count."""
    return df.withColumns({f"o_{name}": filled(F.get_json_object(body, f"$.{name}")) for name in OVERRIDES})


def _effective(df: DataFrame) -> DataFrame:
    """The values that count: corrections over what was read."""
    own = lambda name: F.nullif(F.col(f"o_{name}"), F.lit("")) if f"o_{name}" in df.columns else F.lit(None).cast("string")
    read = lambda name: F.nullif(F.col(f"record.{name}"), F.lit(""))
    day = lambda o, name: F.when(o.isNotNull(), iso_date(o)).otherwise(F.col(f"record.{name}"))
    days = own("dias")
    return df.withColumns(
        {
            "number": F.coalesce(own("cedula"), read("paciente.documento_numero")),
            "code": F.coalesce(own("cie10"), read("diagnostico.cie10")),
            "insurer_text": F.coalesce(own("eps"), read("entidad.eps")),
            "start": day(own("fecha_inicio"), "incapacidad.fecha_inicio"),
            "end": day(own("fecha_fin"), "incapacidad.fecha_fin"),
            "days": F.when(days.isNotNull(), day_count(days)).otherwise(F.col("record.incapacidad.dias")),
            "read_name": F.coalesce(own("paciente"), read("paciente.nombre")),
            "start_calculated": F.coalesce(F.col("record.incapacidad.fecha_inicio_calculada"), F.lit(False)) & own("fecha_inicio").isNull(),
            "own_type": day_count(own("tipo")),
            "own_level": day_count(own("nivel")),
            "order_number": own("numeroorden"),
            "is_permit": F.col("record.tipo_documento") == "permiso",
            "is_holiday": F.col("record.tipo_documento") == "vacaciones",
            "channel_code": reception(F.col("channel")),
        }
    )


def absence_type(df: DataFrame) -> DataFrame:
    """Adds type_id: a valid correction; the permit's kind; holidays; traffic; else by the text."""
    text = F.concat_ws(
        " ", *[F.nullif(F.col(f"record.{n}"), F.lit("")) for n in ("incapacidad.tipo", "incapacidad.origen", "diagnostico.descripcion")],
        F.left(F.col("text"), F.lit(TYPE_TEXT)),
    )
    return df.withColumn(
        "type_id",
        F.when(F.col("own_type").isin(list(TYPE_LABELS)), F.col("own_type"))
        .when(F.col("is_permit"), lookup(PERMIT_TYPES, F.col("record.permiso.tipo_remunerado")))
        .when(F.col("is_holiday"), F.lit(HOLIDAY_TYPE))
        .when(F.col("is_traffic"), F.lit(TRAFFIC_TYPE))
        .otherwise(type_of_text(text)),
    )


def problems_and_fields(df: DataFrame) -> DataFrame:
    """Adds problems (texts in their fixed order) and missing_fields (field, label, value)."""
    with_code = ~(F.col("is_permit") | F.col("is_holiday"))
    days = F.col("days")
    told = F.lit
    number, code, no_days = F.col("number"), F.col("code"), days.isNull() | (days == 0)
    rows = [
        (F.col("is_permit") & F.col("type_id").isNull(), told(NO_PERMIT_KIND), "tipo", "Tipo de permiso", None),
        (F.col("emp_id").isNull() & number.isNull(), told(NO_NUMBER), "cedula", "Cédula del paciente", None),
        (F.col("emp_id").isNull() & number.isNotNull(), F.concat(told("Cédula "), number, told(" no encontrada en empleados")), "cedula", "Cédula del paciente", number),
        (with_code & code.isNull(), told(NO_CODE), "cie10", "Código CIE-10", None),
        (with_code & code.isNotNull() & F.col("dx_id").isNull(), F.concat(told("Diagnóstico "), code, told(" no está en el catálogo CIE-10")), "cie10", "Código CIE-10", code),
        (F.col("ins_unknown"), F.when(F.col("is_traffic"), told(NO_TRAFFIC_INSURER)).otherwise(told(NO_INSURER)), "eps", "EPS / Entidad", F.col("insurer_text")),
        (F.col("start").isNull(), told(NO_START), "fecha_inicio", "Fecha de inicio", None),
        (no_days, told(NO_DAYS), "dias", "Días de incapacidad", None),
        (~no_days & ~in_range(days), F.concat(told("Número de días fuera de rango (="), days.cast("string"), told(")")), "dias", "Días de incapacidad", days.cast("string")),
    ]
    fields = [
        F.when(F.coalesce(when, told(False)), F.struct(told(f).alias("campo"), told(label).alias("etiqueta"), (told(None) if v is None else v).cast("string").alias("valor")))
        for when, _, f, label, v in rows
    ]
    lacking = F.when(F.col("present").isNotNull() & (F.size("missing") > 0), F.concat(told(MISSING_DOCUMENTS), F.array_join("missing", ", ")))
    own = [F.when(F.coalesce(when, told(False)), text) for when, text, *_ in rows]
    return df.withColumn("problems", present_list(*own, lacking)).withColumn("missing_fields", present_list(*fields))


def documents_state(df: DataFrame) -> DataFrame:
    """Adds missing and documents. With a set of present documents: the table's requirements or the defaults of the type,
    permits and holidays only themselves. Without one: the table's requirements but the certificate itself."""
    certificate = F.lit("INCAPACIDAD")
    by_kind = (
        F.when(F.col("is_permit"), F.array(F.lit("PERMISO"))).when(F.col("is_holiday"), F.array(F.lit("VACACIONES")))
        .otherwise(F.coalesce("required", default_requirements(F.col("type_id"))))
    )
    assumed = F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda d: d != certificate)
    missing = F.when(F.col("present").isNotNull(), missing_documents(by_kind, F.col("present"))).otherwise(assumed)
    return df.withColumn("missing", missing).withColumn("documents", F.when(F.size("missing") == 0, F.lit("COMPLETA")).otherwise(F.lit("INCOMPLETA")))


def map_to_staging(cases: DataFrame, dims: dict[str, DataFrame], today: date, key: str = "case_id") -> DataFrame:
    """cases with the staging columns and problems, missing_fields, needs_review and labels.

    cases has key (unique), record, text, channel, present (document types, or null if unknown), source, ocr_backend,
    extractor, and may have corrections o_<name> as texts. dims has employees, diagnoses, insurers, requirements (empty
    tables where there is no catalogue).
    """
    df = fill_in(_effective(cases), "start", "end", "days", "start_calculated")
    with_code = ~(F.col("is_permit") | F.col("is_holiday"))
    df = resolve.employee(df, dims["employees"], key, F.col("number"), F.col("read_name"))
    df = resolve.diagnosis(df, dims["diagnoses"], F.when(with_code, F.col("code")))
    df = resolve.insurer(df, dims["insurers"], F.col("insurer_text"), F.col("emp_insurer"), with_code)
    df = absence_type(df)
    df = resolve.requirements(df, dims["requirements"], F.col("ins_id"), F.col("type_id"))
    df = problems_and_fields(documents_state(df))
    label = lookup(TYPE_LABELS, F.col("type_id"))
    level = F.coalesce("own_level", lookup(DEFAULT_LEVEL, F.col("type_id")))
    notes = F.when(F.col("is_permit"), permit_observations(label, "record.permiso")).otherwise(
        observations(
            label, F.when(with_code, F.col("code")), F.when(with_code, F.coalesce("dx_text", F.nullif(F.col("record.diagnostico.descripcion"), F.lit("")))),
            F.nullif(F.col("record.incapacidad.tipo_licencia"), F.lit("")), F.col("record.incapacidad.fecha_expedicion"),
        )
    )
    row = {
        "fecharegistro": F.lit(today), "fechaaccidente": F.lit(None).cast("date"), "fechainicio": F.col("start"), "Numerodias": F.col("days"),
        "fechavencimiento": due_date(F.col("start"), F.col("days")), "numeroorden": F.col("order_number"), "observaciones": notes,
        "original": (F.col("channel_code") == "ORIGINAL").cast("int"), "idlpdiagnosticos": F.when(with_code, F.col("dx_id")),
        "idlpempleado": F.col("emp_id"), "idlptipoausentismo": F.col("type_id"), "idlpnivelincapacidad": level, "idlpentidad": F.col("ins_id"),
        "tipoentidad": F.col("ins_kind"), "idlpestadosrecepausentismos": lookup(RECEPTION, F.col("channel_code")), "cedula_leida": F.col("number"),
        "codigo_diagnostico_leido": F.when(with_code, F.col("code")), "eps_leida": F.when(with_code, F.col("insurer_text")),
        "paciente_leido": F.coalesce(F.nullif(F.col("emp_name"), F.lit("")), F.col("read_name")),
        "confianza_ocr": completeness(with_code, F.col("number"), F.col("code"), F.col("start"), F.col("days")),
        "archivo_origen": F.col("source"), "problemas": F.nullif(F.array_join("problems", "; "), F.lit("")),
        "documentacion_estado": F.col("documents"), "documentos_faltantes": F.nullif(F.array_join("missing", ", "), F.lit("")),
        "estado": F.lit("PENDIENTE_REVISION"),
    }
    more = {
        "needs_review": F.size("problems") > 0, "type_label": label, "level_label": lookup(LEVEL_LABELS, level),
    }
    return df.withColumns(row | more)


def staging_rows(mapped: DataFrame, *more: str) -> DataFrame:
    return mapped.select(*more, *STAGING_COLUMNS)
