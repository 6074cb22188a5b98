"""Reference tables: their definitions, fixed rows, and loading with a fallback to empty tables."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..functions.codes import LEVEL_LABELS, RECEPTION, TYPE_LABELS

#: Columns of the tables, by table name.
TABLES = {
    "lpempleados": "idlpempleado INT, cedula STRING, nombre STRING, eps STRING, activo BOOLEAN",
    "lpdiagnosticos": "idlpdiagnosticos INT, codigo STRING, descripcion STRING",
    "lpentidades": "idlpentidad INT, nombre STRING, nit STRING, tipoentidad INT",
    "lptipoausentismo": "idlptipoausentismo INT, nombre STRING",
    "lpnivelincapacidad": "idlpnivelincapacidad INT, nombre STRING",
    "lpestadosrecepausentismos": "idlpestadosrecepausentismos INT, nombre STRING",
    "lprequisitos_eps": "id INT, idlpentidad INT, idlptipoausentismo INT, documento STRING, obligatorio BOOLEAN",
    "lp_ausentismos_ia": "id BIGINT, " + schema.STAGING + ", creado_en TIMESTAMP",
    "lp_alertas_documentacion": (
        "id BIGINT, id_ausentismo_ia BIGINT, idlpempleado INT, cedula STRING, idlpentidad INT, eps STRING, documentos_faltantes STRING, "
        "mensaje STRING, canal STRING, estado STRING, creado_en TIMESTAMP"
    ),
}
#: Views that rename columns; the first also shows employees who have left.
VIEWS = {
    "vlpempleados": "SELECT idlpempleado, cedula AS nroidentificacion, nombre AS nombrecompleto, eps AS nombreeps FROM {lpempleados}",
    "vlpentidades_ss": "SELECT idlpentidad AS idlpeps, nombre, tipoentidad FROM {lpentidades}",
}
LABELS = {"lptipoausentismo": TYPE_LABELS, "lpnivelincapacidad": LEVEL_LABELS, "lpestadosrecepausentismos": {v: k for k, v in RECEPTION.items()}}

# Documents that insurers ask for, as insurer, absence type and document.
REQUIREMENTS = (
    (1, 3, "INCAPACIDAD"), (1, 3, "EPICRISIS"), (3, 3, "INCAPACIDAD"), (3, 3, "HISTORIA_CLINICA"), (4, 3, "INCAPACIDAD"), (4, 3, "HISTORIA_CLINICA"),
    (5, 3, "INCAPACIDAD"), (5, 3, "HISTORIA_CLINICA"), (6, 2, "INCAPACIDAD"), (6, 2, "FURAT"), (7, 2, "INCAPACIDAD"), (7, 2, "FURAT"),
)


def requirement_seeds(spark: SparkSession) -> DataFrame:
    """The first rows of the table of required documents."""
    return spark.createDataFrame([(k + 1, *row, True) for k, row in enumerate(REQUIREMENTS)], TABLES["lprequisitos_eps"])


def create_tables(spark: SparkSession, database: str) -> None:
    """The tables, as Parquet, with the rows of the label tables and, once, of the required documents; temporary views over
    them."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    for name in LABELS:
        labels(spark, name).write.mode("overwrite").insertInto(f"{database}.{name}")
    if spark.table(f"{database}.lprequisitos_eps").isEmpty():  # users' own rows stay
        requirement_seeds(spark).write.insertInto(f"{database}.lprequisitos_eps")
    for name, query in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS " + query.format(**{t: f"{database}.{t}" for t in TABLES}))


def labels(spark: SparkSession, name: str) -> DataFrame:
    """Codes and labels of one of the label tables."""
    return spark.createDataFrame(sorted(LABELS[name].items()), TABLES[name])


def empty_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Reference tables without rows: with them nothing is found and every case needs review."""
    return {
        "employees": spark.createDataFrame([], schema.EMPLOYEES),
        "diagnoses": spark.createDataFrame([], schema.DIAGNOSES),
        "insurers": spark.createDataFrame([], schema.INSURERS),
        "requirements": spark.createDataFrame([], schema.REQUIREMENTS),
    }


def dims_of_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """Reference tables in the names that the operators take."""
    table = lambda name: spark.table(f"{database}.{name}")
    return {
        "employees": table("lpempleados").selectExpr("idlpempleado id", "cedula id_number", "nombre full_name", "eps insurer", "activo active"),
        "diagnoses": table("lpdiagnosticos").selectExpr("idlpdiagnosticos id", "codigo code", "descripcion description"),
        "insurers": table("lpentidades").selectExpr("idlpentidad id", "nombre keyword", "nit tax_id", "tipoentidad kind"),
        "requirements": table("lprequisitos_eps").selectExpr("id", "idlpentidad insurer_id", "idlptipoausentismo type_id", "documento document", "obligatorio mandatory"),
    }


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; filters and columns go to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


#: What Spark and its drivers call a source that isn't there: tables, databases, connections.
ABSENT = ("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "PATH_NOT_FOUND", "UnknownHostException", "ConnectException", "CommunicationsException", "SQLTransientConnection", "No suitable driver")


def dims_or_empty(spark: SparkSession, load: Callable[[], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], bool]:
    """(reference tables, whether they could be read): empty ones where the source can't be reached or has no such tables.
    Any other error is one, and is raised."""
    try:
        dims = load()
        for df in dims.values():
            df.limit(1).count()
    except (ConnectionError, TimeoutError):
        return empty_dims(spark), False
    except (PySparkException, Py4JJavaError) as problem:
        if not any(word in str(problem) for word in ABSENT):
            raise
        return empty_dims(spark), False
    return dims, True
