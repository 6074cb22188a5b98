"""Views that give the driver's tables the shape of an inbox, of claims and of catalogues. Claims have nulls and
disagreements put in by remainders of their key, so that every rule has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

TYPES = ("INCAPACIDAD", "EPICRISIS", "FURAT", "HISTORIA", "PERMISO", "FURIPS", "OTRO")
PHRASES = (
    "Accidente de TRABAJO", "enfermedad laboral", "licencia de Maternidad", "Licencia por paternidad", "prelicencia", "Tránsito urbano",
    "Enfermedad común", "control general",
)
REQUIREMENTS = (
    (1, 1, 3, "INCAPACIDAD"), (2, 1, 3, "HISTORIA"), (3, 1, 2, "FURAT"), (4, 5, 2, "INCAPACIDAD"), (5, 5, 2, "FURAT"), (6, 2, 5, "NACIDOVIVO"),
    (7, 0, 11, "FURIPS"), (8, 0, 11, "INCAPACIDAD"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each line item: key columns, path <channel>/<name>, channel."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    digit = F.left("o_orderpriority", F.lit(1))
    folder = F.when(digit == "1", "original").when(digit == "2", "correo").otherwise("whatsapp")
    good = F.concat((F.lit(100000000) + F.col("l_orderkey")).cast("string"), F.lit("_"), pick(TYPES, F.col("l_linenumber") - 1), F.lit(".pdf"))
    odd = F.concat(F.lit("IMG_"), F.col("l_orderkey").cast("string"), F.lit(".jpg"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    named = joined.withColumns({"folder": folder, "name": F.when(F.col("l_partkey") % 17 == 0, odd).otherwise(good)})
    return named.withColumns({"path": F.concat_ws("/", "folder", "name"), "channel": F.upper("folder")}).drop("o_orderkey", "o_orderpriority")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each order."""
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    less = F.when(k % 50 == 3, 40).otherwise(0)
    customer = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    insurer = (
        F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.lit("SOAT NACIONAL"))
        .when((k % 9).isin(2, 3), F.concat(F.lit("EPS NATION_"), (k % 25).cast("string"))).otherwise(F.concat(F.lit("EPS "), F.col("o_orderpriority")))
    )
    return o.select(
        k.alias("claim_id"),
        "o_custkey",
        F.when(k % 11 != 0, F.col("o_custkey").cast("string")).alias("person_key"),
        F.when(k % 2 == 0, F.concat(F.lit("Sr "), customer)).alias("person_name"),
        F.when(k % 7 != 0, day).alias("start"),
        F.when(k % 5 != 0, F.date_add(day, (k % 30 - less).cast("int"))).alias("end"),
        F.when(k % 6 != 0, (k % 30 + F.when(k % 4 == 0, 2).otherwise(1)).cast("int")).alias("days"),
        insurer.alias("insurer_text"),
        F.when(k % 13 != 0, (k % 2500).cast("string")).alias("dx_code"),
        pick(("incapacidad", "permiso", "vacaciones"), k % 3).alias("kind"),
        (k % 10 == 0).alias("anchored"),
        pick(PHRASES, k % 8).alias("phrase"),
        F.when(k % 4 == 0, "REMUNERADO").when(k % 4 == 1, "NO_REMUNERADO").alias("paid"),
        F.when(k % 97 == 0, F.lit("1")).alias("o_cedula"),
        F.when(k % 101 == 0, F.lit("9")).alias("o_tipo"),
        F.when(k % 103 == 0, F.lit("12")).when(k % 107 == 0, F.lit("x")).alias("o_dias"),
        F.when(k % 109 == 0, F.lit("2031-01-05")).when(k % 113 == 0, F.lit("2031-02-31")).alias("o_fecha_inicio"),
        pick(("WHATSAPP", "correo", "Original", "fax"), k % 4).alias("channel"),
    )


def dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Employees from customers, diagnoses from parts (a dot after the third digit), insurers from nations."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    code = F.col("p_partkey").cast("string")
    return {
        "employees": customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("c_custkey").cast("int").alias("id"), F.col("c_custkey").cast("string").alias("id_number"), F.col("c_name").alias("full_name"),
            F.col("n_name").alias("insurer"), F.lit(True).alias("active"),
        ),
        "diagnoses": table(spark, sf_dir, "part").select(
            F.col("p_partkey").cast("int").alias("id"),
            F.when(F.length(code) > 3, F.concat(F.left(code, F.lit(3)), F.lit("."), F.substring(code, 4, 9))).otherwise(code).alias("code"),
            F.col("p_type").alias("description"),
        ),
        "insurers": nation.select(
            F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("keyword"), F.lit(None).cast("string").alias("tax_id"),
            (F.col("n_regionkey") % 2 + 1).cast("int").alias("kind"),
        ),
        "requirements": spark.createDataFrame([(*r, True) for r in REQUIREMENTS], schema.REQUIREMENTS),
    }


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in the shape that the mapper takes."""
    c = claims(spark, sf_dir)
    k = F.col("claim_id")
    values = {
        "tipo_documento": F.col("kind"), "paciente.documento_numero": F.col("person_key"), "paciente.nombre": F.col("person_name"),
        "entidad.eps": F.col("insurer_text"), "incapacidad.fecha_inicio": F.col("start"), "incapacidad.fecha_fin": F.col("end"),
        "incapacidad.dias": F.col("days"), "incapacidad.origen": F.col("phrase"), "incapacidad.inicio_anclada": F.col("anchored"),
        "incapacidad.tipo_licencia": F.when(k % 17 == 0, F.lit("PARTO VIABLE")), "incapacidad.fecha_expedicion": F.when(k % 19 == 0, F.lit("2031-03-01").cast("date")),
        "diagnostico.cie10": F.col("dx_code"), "diagnostico.descripcion": F.when(k % 23 == 0, F.lit("texto leido")),
        "permiso.tipo_remunerado": F.col("paid"), "permiso.empresa": F.when(k % 2 == 0, F.lit("Faro SA")), "permiso.cargo": F.when(k % 5 == 0, F.lit("Analista")),
        "permiso.horas_total": F.when(k % 7 == 0, F.lit("3")), "permiso.horas_desde": F.when(k % 3 == 1, F.lit("8:00")),
        "permiso.autorizado_por": F.when(k % 11 == 0, F.lit("Jefa")), "permiso.autorizado_cargo": F.when(k % 22 == 0, F.lit("Gerente")),
    }
    arrays = (None, ("INCAPACIDAD",), ("INCAPACIDAD", "FURAT"), ("HISTORIA_CLINICA", "INCAPACIDAD"), ("PERMISO", "VACACIONES"))
    present = F.lit(None).cast("array<string>")
    for i, own in enumerate(arrays):
        if own:
            present = F.when(k % 5 == i, F.array(*[F.lit(x) for x in own])).otherwise(present)
    return c.withColumns(
        {
            "record": schema.record(values), "text": F.lit(""), "present": present, "source": F.concat(k.cast("string"), F.lit(".pdf")),
            "ocr_backend": F.lit("stub"), "extractor": F.lit("rule-based"),
        }
    ).drop("start", "end", "days", "insurer_text", "kind", "anchored", "phrase", "paid", "person_key", "person_name", "dx_code")
