"""Types of the extracted record and the staging table. Names of record and staging columns are fixed by their readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTIONS = {
    "paciente": "nombre string, documento_tipo string, documento_numero string",
    "entidad": "eps string, ips_prestador string",
    "incapacidad": (
        "fecha_inicio date, fecha_fin date, dias int, fecha_expedicion date, tipo string, origen string, tipo_licencia string, "
        "inicio_anclada boolean, fecha_inicio_calculada boolean"
    ),
    "diagnostico": "cie10 string, descripcion string",
    "medico": "nombre string, registro string",
    "permiso": (
        "empresa string, cargo string, fecha_solicitud date, tipo_remunerado string, detalle string, horas_desde string, "
        "horas_hasta string, horas_total string, autorizado_por string, autorizado_cargo string"
    ),
}
ENTRY = "path string, modified timestamp, size bigint"
EMPLOYEES = "id int, id_number string, full_name string, insurer string, active boolean"
DIAGNOSES = "id int, code string, description string"
INSURERS = "id int, keyword string, tax_id string, kind int"
REQUIREMENTS = "id int, insurer_id int, type_id int, document string, mandatory boolean"

STAGING = (
    "fecharegistro date, fechaaccidente date, fechainicio date, Numerodias int, fechavencimiento date, numeroorden string, observaciones string, "
    "original int, idlpdiagnosticos int, idlpempleado int, idlptipoausentismo int, idlpnivelincapacidad int, idlpentidad int, tipoentidad int, "
    "idlpestadosrecepausentismos int, cedula_leida string, codigo_diagnostico_leido string, eps_leida string, paciente_leido string, "
    "confianza_ocr decimal(4,3), ocr_backend string, extractor string, archivo_origen string, problemas string, documentacion_estado string, "
    "documentos_faltantes string, estado string"
)
STAGING_COLUMNS = [c.split()[0] for c in STAGING.split(", ")]
ALERT_COLUMNS = ["id_ausentismo_ia", "idlpempleado", "cedula", "idlpentidad", "eps", "documentos_faltantes", "mensaje", "canal", "estado"]


def record(values: dict[str, Column]) -> Column:
    """A record from columns by dotted name; fields not given are null."""
    kind = F.coalesce(values.get("tipo_documento", F.lit(None)).cast("string"), F.lit("incapacidad")).alias("tipo_documento")
    sections = []
    for section, fields in SECTIONS.items():
        own = [values.get(f"{section}.{f}", F.lit(None)).cast(t).alias(f) for f, t in (x.split() for x in fields.split(", "))]
        sections.append(F.struct(*own).alias(section))
    return F.struct(kind, *sections)


def empty_record(kind: str = "incapacidad") -> Column:
    return record({"tipo_documento": F.lit(kind)})
