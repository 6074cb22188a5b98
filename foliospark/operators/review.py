"""The review of staging rows: corrections, states, alerts, catalogues, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, safe_folder
from ..functions.dates import path_parts
from ..functions.names import short_name

#: Fixed values.
APPROVED, REJECTED, PENDING = "APROBADO", "RECHAZADO", "PENDIENTE_REVISION"
#: Staging columns that a review may write.
UPDATABLE = (
    "fechainicio", "Numerodias", "fechavencimiento", "numeroorden", "observaciones", "original", "idlpdiagnosticos", "idlpempleado",
    "idlptipoausentismo", "idlpnivelincapacidad", "idlpentidad", "tipoentidad", "idlpestadosrecepausentismos", "cedula_leida",
    "codigo_diagnostico_leido", "eps_leida", "paciente_leido", "confianza_ocr", "problemas", "documentacion_estado", "documentos_faltantes",
)
LIST_COLUMNS = (
    "id", "estado", "fecharegistro", "fechainicio", "Numerodias", "fechavencimiento", "idlpempleado", "idlpdiagnosticos", "idlpentidad",
    "idlptipoausentismo", "cedula_leida", "paciente_leido", "codigo_diagnostico_leido", "confianza_ocr", "archivo_origen", "problemas",
    "documentacion_estado",
)
NOTE = 65000


def latest(staging: DataFrame, state: str = "", limit: int = 20, columns=LIST_COLUMNS) -> DataFrame:
    """The newest rows by id, of one state if one is named."""
    rows = staging.where(F.col("estado") == state.upper()) if state else staging
    return rows.select(*[c for c in columns if c in staging.columns]).orderBy(F.desc("id")).limit(limit)


def _appended(notes: Column, note: Column) -> Column:
    """A note at the end, parted by a bar; no bar at either end."""
    return F.left(F.regexp_replace(F.concat(F.coalesce(notes, F.lit("")), F.lit(" | "), note), r"^[ |]+|[ |]+$", ""), F.lit(NOTE))


def apply_review(staging: DataFrame, updates: DataFrame, columns=UPDATABLE) -> DataFrame:
    """staging with the rows of updates (id, state, note, some of the columns) put in their place: one row per id.

    Only the named columns are written; a null note leaves the observations as they are. Tables of files take no updates in
    place, so the result is a new version of the table.
    """
    own = [c for c in columns if c in updates.columns and c in staging.columns]
    new = updates.select(F.col("id").alias("__id"), F.col("state").alias("__state"), F.col("note").alias("__note"), *[F.col(c).alias(f"__{c}") for c in own])
    hit = F.col("__id").isNotNull()
    joined = staging.join(new, F.col("id") == F.col("__id"), "left")
    value = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in own}
    notes = value.get("observaciones", F.col("observaciones"))
    value["observaciones"] = F.when(hit & F.col("__note").isNotNull(), _appended(notes, F.col("__note"))).otherwise(notes)
    value["estado"] = F.coalesce("__state", "estado")
    return joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in staging.columns])


def set_state(staging: DataFrame, changes: DataFrame) -> DataFrame:
    """staging with the states of changes (id, state, note); a note goes after a bar, even after no notes."""
    new = changes.select(F.col("id").alias("__id"), F.col("state").alias("__state"), F.col("note").alias("__note"))
    joined = staging.join(new, F.col("id") == F.col("__id"), "left")
    noted = F.left(F.concat(F.coalesce("observaciones", F.lit("")), F.lit(" | "), F.col("__note")), F.lit(NOTE))
    value = {"estado": F.coalesce("__state", "estado"), "observaciones": F.when(F.col("__note").isNotNull(), noted).otherwise(F.col("observaciones"))}
    return joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in staging.columns])


def missing_for_approval(strict: bool = True) -> Column:
    """Labels of what a row lacks for approval without corrections: employee, diagnosis, start, days (0 counts as none).
    Unless strict, types without a diagnosis (permits, holidays) don't need one."""
    lacks = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "0")
    diagnosis = lacks("idlpdiagnosticos")
    if not strict:
        diagnosis = diagnosis & ~F.coalesce(F.col("idlptipoausentismo").isin(7, 12, 13), F.lit(False))
    rows = [(lacks("idlpempleado"), "empleado"), (diagnosis, "diagnóstico"), (F.col("fechainicio").isNull(), "fecha de inicio"), (lacks("Numerodias"), "días")]
    return F.filter(F.array(*[F.when(w, F.lit(label)) for w, label in rows]), lambda x: x.isNotNull())


def decide(staging: DataFrame, requests: DataFrame, strict: bool = True) -> DataFrame:
    """Outcome of requests (id, action aprobar, rechazar or guardar, and has_body): 404 unknown id, 400 saving nothing, 409
    approval of a row that lacks fields or, with a body, has problems; else 200 with the new state."""
    rows = staging.select(F.col("id").alias("__id"), "problemas", missing_for_approval(strict).alias("lacking"))
    j = requests.join(rows, F.col("id") == F.col("__id"), "left")
    approve, save = F.col("action") == "aprobar", F.col("action") == "guardar"
    blocked = F.when(F.col("has_body"), F.col("problemas").isNotNull()).otherwise(F.size("lacking") > 0)
    code = (
        F.when(~F.col("action").isin("aprobar", "rechazar", "guardar") | (save & ~F.col("has_body")), 400)
        .when(F.col("__id").isNull(), 404).when(approve & blocked, 409).otherwise(200)
    )
    state = F.when(approve, F.lit(APPROVED)).when(F.col("action") == "rechazar", F.lit(REJECTED)).otherwise(F.lit(PENDING))
    return j.select("id", "action", code.alias("code"), F.when(code == 200, state).alias("state"), "lacking")


def register(mapped: DataFrame, asked: Column, reason: Column) -> DataFrame:
    """mapped rows with code and the state asked for at once: 409 for the approval of a row that needs review, which stays pending,
    else 200. States that there aren't count as pending; a rejection's reason goes to the observations."""
    upper = F.upper(F.coalesce(asked, F.lit("")))
    blocked = (upper == APPROVED) & F.col("needs_review")
    told = (upper == REJECTED) & (F.coalesce(reason, F.lit("")) != "")
    return mapped.withColumns(
        {
            "code": F.when(blocked, 409).otherwise(200),
            "estado": F.when(upper.isin(APPROVED, REJECTED) & ~blocked, upper).otherwise(F.lit(PENDING)),
            "observaciones": F.when(told, _appended(F.col("observaciones"), F.concat(F.lit("RECHAZADO: "), reason))).otherwise(F.col("observaciones")),
        }
    )


def alerts(staging: DataFrame, number: Column, channel: Column) -> DataFrame:
    """An alert for each row whose documents are incomplete (not for rows that only need review)."""
    lacking = F.coalesce("documentos_faltantes", F.lit("documentos requeridos"))
    text = F.concat(F.lit("Faltan soportes para el ausentismo del empleado "), number, F.lit(": "), lacking, F.lit("."))
    return staging.where(F.col("documentacion_estado") == "INCOMPLETA").select(
        F.col("id").alias("id_ausentismo_ia"), "idlpempleado", number.alias("cedula"), "idlpentidad", F.col("eps_leida").alias("eps"),
        lacking.alias("documentos_faltantes"), text.alias("mensaje"), channel.alias("canal"), F.lit("PENDIENTE").alias("estado"),
    )


def upsert(catalogue: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The catalogue with rows put in by key; of several rows of one key the last by order."""
    new = rows
    if order:
        rest = [c for c in rows.columns if c not in (key, order)]
        new = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")
    columns = catalogue.columns
    kept = catalogue.join(new.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return kept.select(columns).unionByName(new.select(columns))


def add_ids(rows: DataFrame, natural_key: list[str]) -> DataFrame:
    """rows with an id that the natural key alone decides, the same in every run."""
    return rows.withColumn("id", F.shiftrightunsigned(F.xxhash64(*natural_key), 1))


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose id isn't stored yet."""
    return rows.join(stored.select("id"), "id", "left_anti")


def routes(files: DataFrame, complete: Column, failed: Column, name: Column, number: Column, start: Column, given=()) -> DataFrame:
    """Adds dest and collision: where a file goes by its case's outcome, and whether another file goes to the same place."""
    person = F.coalesce(F.nullif(safe_folder(short_name(name, given)), F.lit("")), F.concat(F.lit("SIN NOMBRE "), number))
    folder = F.when(complete, F.lit("procesados")).otherwise(F.lit("incompletos"))
    by_person = F.concat_ws("/", folder, person, F.array_join(path_parts(start), "/"))
    place = F.when(number.isNull(), F.lit("inbox/sin_nomenclatura")).when(failed, F.concat(F.lit("cuarentena/"), number)).otherwise(by_person)
    routed = files.withColumn("dest", F.concat_ws("/", place, base_name(F.col("path"))))
    twice = routed.groupBy(F.col("dest").alias("__d")).agg((F.count("*") > 1).alias("collision"))
    return routed.join(twice, F.col("dest") == F.col("__d")).drop("__d")
