"""Queries over the driver's tables, one or more for each operator; oracle.py has the SQL that must give the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import codes, dates, names, replies, text
from .operators import cases, mapper, merge, output, reconcile, report, resolve, review
from .oracle import ORACLES
from .plans import pipeline
from .sources import catalog, inbox, letters, pages, views
from .sources.session import settled, spread
from .sources.views import table

TODAY = date(2031, 1, 1)
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
#: Different words of the lexicon that splits glued part names; more are refused.
MAX_LEXICON = 100_000
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return cases.parse_names(views.files(spark, d))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases with an absence type by the number of their files."""
    own = cases.cases(_parsed(spark, d))
    return own.withColumn("type_id", views.pick((2, 3, 11), F.col("n_files") % 3))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = pipeline.reconcile_record(views.case_rows(spark, d))
    return mapper.map_to_staging(rows, views.dims(spark, d), TODAY, "claim_id")


def _staging(spark: SparkSession, d: str) -> DataFrame:
    """The staging table of all claims; a claim's number is its row's id."""
    return mapper.staging_rows(_mapped(spark, d).withColumn("id", F.col("claim_id")), "id", "claim_id", "channel")


@query
def q01_parse_names(spark, d):
    return _parsed(spark, d).select(*KEYS, "name", "id_number", "doc_type", "case_id")


@query
def q02_name_split_counts(spark, d):
    return cases.inbox_counts(_parsed(spark, d))


@query
def q03_channel(spark, d):
    own = views.files(spark, d).withColumn("channel", cases.channel_of(F.col("path")))
    rows = own.groupBy("channel").agg(F.count("*").alias("n_files"))
    return rows.withColumn("code", codes.lookup(codes.RECEPTION, codes.reception(F.col("channel"))))


@query
def q04_cases(spark, d):
    own = cases.cases(_parsed(spark, d))
    return own.select("case_id", F.array_join("present", ",").alias("present"), "n_files", "n_base", "base", "base_type", "first_path", "channel")


@query
def q05_doc_requirements(spark, d):
    own = cases.check_default_documents(_cases(spark, d), F.col("type_id"), F.col("present"))
    return own.select("case_id", "type_id", F.array_join("missing", ",").alias("missing"), "documents")


@query
def q06_required_anti(spark, d):
    own = _cases(spark, d)
    required = own.select("case_id", F.explode(codes.default_requirements(F.col("type_id"))).alias("document"))
    present = _parsed(spark, d).where(F.col("case_id").isNotNull()).select("case_id", F.col("doc_type").alias("document"))
    return cases.missing_by_anti_join(required, present)


@query
def q07_run_summary(spark, d):
    done = cases.check_default_documents(_cases(spark, d), F.col("type_id"), F.col("present"))
    stray = cases.split_names(_parsed(spark, d))[1]
    return cases.run_summary(done, stray, (F.col("documents") == "COMPLETA") & (F.col("n_base") <= 1), F.col("n_files") % 10 == 9)


@query
def q08_canon_doc(spark, d):
    raw = F.concat(F.lower("doc_type"), F.when(F.col("l_partkey") % 2 == 0, F.lit("_1")).otherwise(F.lit("")))
    own = _parsed(spark, d).where(F.col("doc_type").isNotNull()).select(raw.alias("token")).distinct()
    named = own.withColumn("canonical", codes.canonical_document(F.col("token")))
    return named.withColumn("doc_group", codes.document_group(F.col("canonical")))


@query
def q10_page_select(spark, d):
    own = table(spark, d, "conversations").withColumnsRenamed({"conv_id": "doc_id", "turn": "page_no"})
    return cases.page_text(own, F.col("role") == "assistant")


@query
def q11_page_cap(spark, d):
    own = table(spark, d, "conversations").select("conv_id", "turn")
    return cases.first_pages(own, 2, "conv_id", "turn")


@query
def q12_min_text_guard(spark, d):
    own = pipeline.extract(table(spark, d, "documents").select("doc_id", "text"), lambda df: df.withColumn("record", schema.empty_record()), least=200)
    return own.select("doc_id", F.col("note").isNull().alias("enough"), "note")


@query
def q13_text_ids(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.find(t, "([0-9]{6,16})").alias("number"), text.near(t, "the", "([a-z]+)", 30).alias("after_the"))


@query
def q14_first_label_value(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", text.near(h, "<title>", "([A-Za-z]+)", 40).alias("word"), text.near(h, "html lang=", '"([a-z]+)"', 20).alias("lang")
    )


def _rendered(o_key, day):
    """A date in one of three shapes, or one that the calendar doesn't have."""
    month = views.pick([m for m in dates.SHORT_MONTHS if m != "set"], F.month(day) - 1)
    return (
        F.when(o_key % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(o_key % 5 == 1, F.date_format(day, "d/M/yyyy"))
        .when(o_key % 5 == 2, F.concat(F.date_format(day, "dd-"), month, F.date_format(day, "-yy"))).when(o_key % 5 == 3, F.lit("31/02/2026"))
        .otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-13-01")))
    )


@query
def q15_dates_norm(spark, d):
    raw = _rendered(F.col("o_orderkey"), F.to_date("o_orderdate"))
    own = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    labelled = F.concat(F.lit("Nota 7. Fecha Inicio: "), F.col("raw"), F.lit(" fin"))
    return own.select("o_orderkey", "raw", dates.any_date(F.col("raw")).alias("day"), dates.labelled_date(labelled, r"fecha\s*inicio").alias("labelled"))


@query
def q16_code_candidates(spark, d):
    k = F.col("p_partkey")
    code = F.concat(F.lit("K"), F.lpad((k % 100).cast("string"), 2, "0"), (k % 10).cast("string"))
    note = F.concat(F.lit("Nota A01 y SOL. "), F.when(k % 3 == 0, F.lit("B2O ")).otherwise(F.lit("")), F.lit("Diagnostico: "), code, F.lit("HERNIA Z99"))
    plain = F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 90 + 10).cast("string"))).otherwise(F.lit("42.0"))
    return table(spark, d, "part").select(
        "p_partkey", codes.best_diagnosis(note).alias("best"), codes.diagnosis_code(plain).alias("code"), codes.diagnosis_fixes(views.pick(("kIO,5", "K10.5", "KZ|", "xx", None), k % 5)).alias("fixes")
    )


@query
def q17_deaccent(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query
def q18_form_dispatch(spark, d):
    k = F.col("o_orderkey")
    heads = ("SOLICITUDDEPERMISO", "Notificación de periodos de VACACIONES", "Certificado de  incapacidad", "Detalle de la incapacidad medica", "epicrisis")
    t = F.concat(F.lit("hoja "), views.pick(heads, k % 5), F.lit(" no. "), k.cast("string"))
    own = table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    t = F.col("t")
    kind = F.when(pages.is_permit(t), "permiso").when(pages.is_holiday(t), "vacaciones").otherwise("incapacidad")
    return own.select("o_orderkey", pages.is_relevant(t).alias("relevant"), kind.alias("kind"))


@query
def q20_employee_by_id(spark, d):
    own = resolve.employee_by_number(views.claims(spark, d).select("claim_id", "person_key"), views.dims(spark, d)["employees"], F.col("person_key"))
    return own.select("claim_id", "emp_id", "emp_name", "emp_insurer")


@query
def q21_employee_by_name(spark, d):
    own = views.claims(spark, d).select("claim_id", "person_name")
    return resolve.employee_by_name(own, views.dims(spark, d)["employees"], "claim_id", F.col("person_name"))


@query
def q22_employee_fallback(spark, d):
    own = views.claims(spark, d).select("claim_id", "person_key", "person_name")
    return resolve.employee(own, views.dims(spark, d)["employees"], "claim_id", F.col("person_key"), F.col("person_name")).select("claim_id", "emp_id", "emp_name")


@query
def q23_diagnosis_code(spark, d):
    own = views.claims(spark, d).select("claim_id", "dx_code")
    return resolve.diagnosis(own, views.dims(spark, d)["diagnoses"], F.col("dx_code")).select("claim_id", "dx_id", "dx_text")


@query
def q24_insurer_keyword(spark, d):
    own = views.claims(spark, d).select("claim_id", "insurer_text")
    found = resolve.insurer_by_keyword(own, views.dims(spark, d)["insurers"], F.col("insurer_text"))
    return found.select("claim_id", "ins_id", "ins_kind", "ins_name")


@query
def q25_insurer_chain(spark, d):
    return _mapped(spark, d).select("claim_id", "is_traffic", "ins_id", "ins_kind", "ins_name", "ins_from_employee", "ins_unknown")


@query
def q26_type_ladder(spark, d):
    own = views.claims(spark, d).select("claim_id", codes.type_of_text(F.concat(F.lit("hoja "), F.col("phrase"))).alias("type_id"))
    return own.withColumn("label", codes.lookup(codes.TYPE_LABELS, F.col("type_id")))


@query
def q27_type_precedence(spark, d):
    return _mapped(spark, d).select("claim_id", "type_id", "type_label", "idlpnivelincapacidad", "level_label")


@query
def q28_requirements_lookup(spark, d):
    own = views.claims(spark, d).select("claim_id", (F.col("claim_id") % 7).cast("int").alias("insurer"), views.pick((2, 3, 5, 11), F.col("claim_id") % 4).alias("type_id"))
    found = resolve.requirements(own, views.dims(spark, d)["requirements"], F.col("insurer"), F.col("type_id"))
    return found.select("claim_id", F.array_join("required", ",").alias("required"))


@query
def q29_full_enrichment(spark, d):
    return _mapped(spark, d).select("claim_id", "emp_id", "dx_id", "ins_id", "type_id", F.array_join("missing", ",").alias("missing"), "documents")


@query
def q30_date_reconcile(spark, d):
    own = views.claims(spark, d).select("claim_id", "start", "end", "days", "anchored")
    return reconcile.reconcile(own, "start", "end", "days", F.col("anchored")).select("claim_id", "start", "end", "days", "start_calculated")


@query
def q31_due_date(spark, d):
    own = views.claims(spark, d)
    return own.select("claim_id", dates.due_date(F.col("start"), F.col("days")).alias("due"), F.array_join(dates.path_parts(F.col("start")), "/").alias("folder"))


@query
def q32_days_between(spark, d):
    own = views.claims(spark, d)
    far = F.date_add("end", F.when(F.col("claim_id") % 3 == 0, 540).otherwise(0))
    return own.select("claim_id", dates.days_between(F.col("start"), far).alias("days_between"), dates.in_range(F.col("days")).alias("days_ok"))


@query
def q33_completeness(spark, d):
    return _mapped(spark, d).select("claim_id", F.col("confianza_ocr").cast("double").alias("share"))


@query
def q34_problems(spark, d):
    fields = F.array_join(F.transform("missing_fields", lambda x: F.concat_ws("=", x["campo"], x["valor"])), ",")
    return _mapped(spark, d).select("claim_id", "problemas", fields.alias("fields"), "needs_review")


@query
def q35_observations(spark, d):
    return _mapped(spark, d).select("claim_id", "observaciones", "paciente_leido")


@query
def q36_staging_rows(spark, d):
    return mapper.staging_rows(_mapped(spark, d), "claim_id").drop("confianza_ocr", "fechaaccidente")


@query
def q40_merge_records(spark, d):
    """Two records of each claim: the rules' and a model's with gaps and an invented date."""
    c = views.claims(spark, d)
    k = F.col("claim_id")
    rule = schema.record({
        "paciente.documento_numero": F.col("person_key"), "paciente.nombre": F.col("person_name"), "incapacidad.fecha_inicio": F.col("start"),
        "incapacidad.fecha_fin": F.col("end"), "incapacidad.dias": F.col("days"), "incapacidad.origen": F.col("phrase"),
        "incapacidad.inicio_anclada": F.col("anchored"), "diagnostico.cie10": F.col("dx_code"), "tipo_documento": F.col("kind"),
    })
    model = schema.record({
        "paciente.documento_numero": F.lit("999"), "paciente.nombre": F.when(k % 3 != 0, F.lit("Modelo")), "incapacidad.dias": F.when(k % 8 == 0, 4),
        "incapacidad.fecha_inicio": F.when(k % 4 == 0, F.date_add("start", 1)).when(k % 4 == 1, F.lit("2031-01-01").cast("date")),
        "incapacidad.origen": F.when(k % 5 == 0, F.lit("codigo 12")).when(k % 5 == 1, F.lit("Origen LABORAL")),
    })
    whole = F.concat_ws(" ", F.lit("del"), F.col("start").cast("string"), F.lit("o"), F.date_add("start", 1).cast("string"), F.lit("al"), F.col("end").cast("string"))
    own = c.select("claim_id", rule.alias("rule"), model.alias("model"), whole.alias("t"), (k % 7 == 1).alias("failed"))
    r = merge.merge(own, "rule", "model", F.col("failed"), F.col("t"))
    inc = "record.incapacidad."
    return r.select(
        "claim_id", "record.paciente.nombre", "record.paciente.documento_numero", F.col(inc + "fecha_inicio").alias("start"),
        F.col(inc + "fecha_fin").alias("end"), F.col(inc + "dias").alias("days"), F.col(inc + "origen").alias("origin"), "record.diagnostico.cie10",
    )


@query
def q41_origin_clean(spark, d):
    raw = F.when(F.col("claim_id") % 9 == 0, F.concat(F.lit("x"), F.col("claim_id").cast("string"))).when(F.col("claim_id") % 9 == 1, F.lit("  ")).otherwise(F.col("phrase"))
    own = views.claims(spark, d).select("claim_id", codes.clean_origin(raw).alias("origin"))
    return own.withColumn("licence", codes.licence(F.when(F.col("claim_id") % 2 == 0, F.lit("parto no viable")).otherwise(F.lit(" Otra "))))


@query
def q42_json_rescue(spark, d):
    k = F.col("event_id")
    reply = (
        F.when(k % 4 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("Claro: "), F.col("props"), F.lit(" fin")))
        .when(k % 4 == 2, F.col("props")).otherwise(F.lit("nada"))
    )
    return table(spark, d, "events").select(
        "event_id", F.get_json_object(replies.json_text(reply), "$.k").cast("bigint").alias("k"), replies.reply_failed(reply).alias("failed")
    )


@query
def q50_staging_topk(spark, d):
    return review.latest(_staging(spark, d), "pendiente_revision", 20, ("id", "estado", "fechainicio", "Numerodias", "idlpempleado", "problemas"))


def _updates(spark, d):
    own = table(spark, d, "orders").where(F.col("o_orderkey") % 3 == 0)
    return own.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(review.APPROVED)).alias("state"),
        F.when(F.col("o_orderkey") % 6 == 0, F.lit("visto")).alias("note"), F.lit("O-1").alias("numeroorden"), (F.col("o_orderkey") % 40).cast("int").alias("Numerodias"),
    )


@query
def q51_review_apply(spark, d):
    return review.apply_review(_staging(spark, d), _updates(spark, d)).select("id", "estado", "numeroorden", "Numerodias", "observaciones")


@query
def q52_state_update(spark, d):
    return review.set_state(_staging(spark, d), _updates(spark, d)).select("id", "estado", "Numerodias", "observaciones")


@query
def q53_quick_approval(spark, d):
    o = F.col("o_orderkey")
    actions = table(spark, d, "orders").select(
        F.when(o % 50 == 0, -o).otherwise(o).alias("id"), views.pick(("aprobar", "rechazar", "guardar", "otra"), o % 4).alias("action"), (o % 8 < 2).alias("has_body")
    )
    return review.decide(_staging(spark, d), actions).select("id", "action", "code", "state", F.array_join("lacking", ",").alias("lacking"))


@query
def q54_alerts(spark, d):
    own = _staging(spark, d)
    return review.alerts(own, F.col("claim_id").cast("string"), codes.reception(F.col("channel")))


@query
def q55_catalog_upsert(spark, d):
    own = table(spark, d, "nation").select("n_nationkey", "n_name")
    more = spark.createDataFrame([(1, "UNO", 1), (1, "UNO BIS", 2), (90, "NOVENTA", 1)], "n_nationkey int, n_name string, at int")
    return review.upsert(own, more, "n_nationkey", "at")


@query
def q56_routing_manifest(spark, d):
    f = cases.parse_names(views.files(spark, d)).withColumn("k", F.col("l_orderkey"))
    c = views.claims(spark, d).select("claim_id", F.col("start").alias("s"))
    own = f.join(c, F.col("k") == F.col("claim_id"), "left")
    person = F.when(F.col("k") % 3 != 0, F.concat(F.lit("Álix  Pérez "), F.col("k").cast("string")))
    moved = review.routes(own, F.col("k") % 2 == 0, F.col("k") % 29 == 0, person, F.col("id_number"), F.col("s"), ("Ana",))
    return moved.select(*KEYS, "dest", "collision")


@query
def q57_batch_cap(spark, d):
    return cases.first_cases(cases.cases(_parsed(spark, d)), 500).select("case_id", "first_path", "n_files")


@query
def q60_accuracy(spark, d):
    """Labels against a rule on the text's length and commas."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^,]", "")).alias("commas"))
    joined = docs.join(table(spark, d, "labels"), "doc_id")
    good = joined.select(
        "lang", report.agrees(F.when(F.col("n") > 1000, 1).otherwise(0), F.col("quality")).alias("a"),
        report.agrees_with_any((F.col("commas") % 3).cast("string"), F.when(F.col("toxic") == 1, F.array(F.lit("1"), F.lit("2")))).alias("b"),
    )
    by_lang = report.accuracy(good, ["a", "b"], "lang")
    return by_lang.unionByName(report.accuracy(good, ["a", "b"]).withColumn("lang", F.lit("all")))


@query
def q61_wordbreak(spark, d):
    """Part names with their words run together, split by the lexicon of those words."""
    words = [r[0] for r in table(spark, d, "part").select(F.explode(F.split(F.upper("p_name"), " "))).distinct().limit(MAX_LEXICON + 1).collect()]
    if len(words) > MAX_LEXICON:
        raise ValueError(f"more than {MAX_LEXICON} different words in p_name")
    glued = F.replace(F.upper("p_name"), F.lit(" "), F.lit(""))
    return table(spark, d, "part").select("p_partkey", names.split_glued(glued, sorted(words)).alias("parts"), names.short_name(F.col("p_name"), ()).alias("short"))


@query
def q62_stub_ocr_pipeline(spark, d):
    """Conversations as documents of pages: stub engine, page choice, guard, extraction."""
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.col("text").cast("binary").alias("content"))
    whole = pages.document_text(pages.recognise(own))
    done = pipeline.extract(whole)
    return done.select("doc_id", F.length("text").alias("n_chars"), "record.tipo_documento", "record.paciente.documento_numero", "note", "error")


@query
def q63_containment_large(spark, d):
    """The indexed containment join of all claims with all employees, whatever their number."""
    reads = views.claims(spark, d).select(F.col("claim_id").alias("__read"), text.squash(F.col("person_name")).alias("__text"))
    people = views.dims(spark, d)["employees"].select(F.col("id").alias("__order"), text.squash(F.col("full_name")).alias("__key"))
    return resolve.containment(reads, people, True, small=0).select(F.col("__read").alias("claim_id"), F.col("__order").alias("emp_id"))


@query
def q64_new_rows(spark, d):
    """A second run over the same cases adds only those not stored yet."""
    rows = review.add_ids(cases.cases(_parsed(spark, d)).select("case_id", "n_files"), ["case_id"])
    stored = rows.where(F.col("n_files") % 2 == 0)
    return review.new_rows(rows, stored).select("case_id", "n_files")




@query
def q65_json_rows(spark, d):
    own = views.claims(spark, d).select("claim_id", "start", "days", "dx_code", "phrase")
    return output.json_rows(own)


@query
def q66_without_catalogue(spark, d):
    """All claims where the catalogue can't be read: nothing is found, and each case says what is missing."""

    def load():
        raise ConnectionError("no catalogue")

    dims, there = catalog.dims_or_empty(spark, load)
    rows = pipeline.reconcile_record(views.case_rows(spark, d))
    mapped = mapper.map_to_staging(rows, dims, TODAY, "claim_id")
    return mapped.select("claim_id", F.lit(there).alias("there"), "emp_id", "dx_id", "ins_id", F.coalesce("paciente_leido", F.lit("?")).alias("name"))


@query
def q67_point_lookup(spark, d):
    return _staging(spark, d).where(F.col("id") == 42).select("id", "estado", "idlptipoausentismo", "cedula_leida")


@query
def q68_label_tables(spark, d):
    own = [catalog.labels(spark, n).toDF("code", "label").withColumn("kind", F.lit(n)) for n in sorted(catalog.LABELS)]
    return own[0].unionByName(own[1]).unionByName(own[2])


@query
def q69_page_sizes(spark, d):
    """Page sizes scaled to the cap on pixels, and refusals of uploads, over sizes made from parts."""
    k = F.col("p_partkey")
    width, height = (k % 97 * 150 + 100).cast("int"), (k % 89 * 140 + 50).cast("int")
    own = table(spark, d, "part").select("p_partkey", width.alias("w"), height.alias("h"), (k * 7001 % 70_000_000).alias("size"))
    size = pages.capped_size(F.col("w"), F.col("h"))
    reason = inbox.upload_reason(k % 5 != 0, F.col("size"), pages.MAX_UPLOAD)
    return own.select("p_partkey", (size["width"].cast("bigint") * size["height"] <= pages.MAX_PIXELS).alias("fits"), reason.alias("refused"), size["width"].alias("width"))


@query
def q70_certificates(spark, d):
    """Certificates of six layouts, each field as printed."""
    r = pipeline.rule_extractor()(letters.certificates(spark, d))
    i = "record.incapacidad."
    return r.select(
        "o_orderkey", F.col("record.tipo_documento").alias("kind"), F.col("record.paciente.documento_tipo").alias("id_kind"),
        F.col("record.paciente.documento_numero").alias("id_number"), F.col("record.paciente.nombre").alias("name"), F.col("record.entidad.eps").alias("insurer"),
        F.col("record.entidad.ips_prestador").alias("provider"), F.col(i + "fecha_expedicion").alias("issued"), F.col(i + "fecha_inicio").alias("first"),
        F.col(i + "fecha_fin").alias("last"), F.col(i + "dias").alias("days"), F.col(i + "tipo").alias("type"), F.col(i + "origen").alias("origin"),
        F.col(i + "tipo_licencia").alias("licence"), F.col(i + "inicio_anclada").alias("anchored"), F.col("record.diagnostico.cie10").alias("code"),
        F.col("record.diagnostico.descripcion").alias("diagnosis"), F.col("record.medico.nombre").alias("doctor"), F.col("record.medico.registro").alias("register"),
    )


@query
def q71_holiday_letters(spark, d):
    r = pipeline.extract(settled(spread(letters.holidays(spark, d))))
    i = "record.incapacidad."
    return r.select(
        "o_orderkey", F.col("record.tipo_documento").alias("kind"), F.col("record.paciente.documento_numero").alias("id_number"), F.col("record.paciente.nombre").alias("name"),
        F.col(i + "fecha_inicio").alias("first"), F.col(i + "fecha_fin").alias("last"), F.col(i + "dias").alias("days"),
    )


@query
def q72_permits(spark, d):
    r = pipeline.extract(settled(spread(letters.permits(spark, d))))
    i, p = "record.incapacidad.", "record.permiso."
    return r.select(
        "o_orderkey", F.col("record.tipo_documento").alias("kind"), F.col("record.paciente.documento_numero").alias("id_number"), F.col("record.paciente.nombre").alias("name"),
        F.col(i + "fecha_inicio").alias("first"), F.col(i + "fecha_fin").alias("last"), F.col(i + "dias").alias("days"), F.col(i + "tipo").alias("type"),
        F.col(p + "empresa").alias("company"), F.col(p + "cargo").alias("post"), F.col(p + "fecha_solicitud").alias("asked"), F.col(p + "tipo_remunerado").alias("paid"),
        F.col(p + "detalle").alias("detail"), F.col(p + "horas_desde").alias("hour_from"), F.col(p + "horas_hasta").alias("hour_to"), F.col(p + "horas_total").alias("hours"),
        F.col(p + "autorizado_por").alias("approver"), F.col(p + "autorizado_cargo").alias("approver_post"),
    )


@query
def q73_names_contained(spark, d):
    """Employees by name, in both directions of containment: names read with more or less than the catalogue's, short ones,
    and ones that several employees hold."""
    own = table(spark, d, "customer").select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("way"), "c_custkey", "c_name")
    digits = F.substring_index("c_name", "#", -1)
    read = (
        F.when(F.col("way") == 0, F.concat(F.lit("Sra. "), F.col("c_name"), F.lit(" S."))).when(F.col("way") == 1, F.concat(F.lit("R#"), digits))
        .when(F.col("way") == 2, F.right(digits, F.lit(5))).when(F.col("way") == 3, F.left("c_name", F.lit(14))).otherwise(F.upper("c_name"))
    )
    own = own.select((F.col("c_custkey") * 5 + F.col("way")).alias("read_id"), read.alias("read"))
    return resolve.employee_by_name(own, views.dims(spark, d)["employees"], "read_id", F.col("read")).select("read_id", "emp_id", "emp_name")


@query
def q74_requirement_seeds(spark, d):
    return catalog.requirement_seeds(spark)


@query
def q75_case_problems(spark, d):
    """Cases from files to staging: the number read against the file name's, several base documents, no number in the text."""
    k = F.col("o_orderkey")
    number = (F.when(k % 5 == 0, 60_000_000).otherwise(80_000_000) + k).cast("string")
    base = table(spark, d, "orders").select(k, number.alias("n"))
    one = base.select("o_orderkey", F.concat("n", F.lit("_INCAPACIDAD.pdf")).alias("path"))
    two = base.where(k % 4 == 1).select("o_orderkey", F.concat("n", F.lit("_INCAPACIDAD_2.pdf")).alias("path"))
    files = one.unionByName(two).select("path", F.lit("CORREO").alias("channel"))
    said = F.when(k % 7 == 3, F.lit("sin numero alguno")).otherwise(F.concat(F.lit("Documento CC: "), (k + 80_000_000).cast("string")))
    texts = one.select("path", F.concat(F.lit("CERTIFICADO DE INCAPACIDAD MEDICA. "), said).alias("text"), F.when(k % 50 == 7, F.lit("unreadable")).alias("error"))
    mapped, _ = pipeline.process_cases(files, texts, catalog.empty_dims(spark), TODAY, limit=None)
    return mapped.select(
        "case_id", F.col("cedula_leida").alias("number"), F.contains("problemas", F.lit("≠ leída")).alias("clash"), F.contains("problemas", F.lit("Hay 2 documentos base")).alias("many"),
        "failed", "n_base", "idlpestadosrecepausentismos",
    )


@query
def q76_text_functions(spark, d):
    """Values after each label, names without what follows them, capitals without accents, dates in cells and dates that belong to
    another label, sizes."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    cells = F.concat_ws(" ", F.dayofmonth(day), F.month(day), F.year(day))
    posts = F.concat(F.lit("Cargo: Analista "), k % 9, F.lit("\nx\nCARGO -\n\n Gerente "), k % 7, F.lit("\ncargo"))
    name = F.concat(F.lit(" Ána  Núñez Güell "), views.pick(("edad 30", "R", ".:", "Fecha x", "Historia 7"), k % 5))
    other = F.concat(F.lit("Fecha Fin:"), day.cast("string"), F.lit("\nFecha Inicio: ninguna"))
    before = F.concat(day.cast("string"), F.lit("\nFecha Inicio"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(text.after_each(posts, r"\bcargo\b", 40), "|").alias("posts"), names.clean_name(name).alias("name"),
        text.ascii_upper(names.clean_name(name)).alias("plain"), dates.labelled_date_or_triplet(F.concat(F.lit("Fecha solicitud | "), cells), "solicitud").alias("asked"),
        dates.labelled_date(other, r"fecha\s*inicio").alias("others"), dates.labelled_date(before, r"fecha\s*inicio").alias("before"),
        text.megabytes((k % 50) * 1_048_576 / 4).alias("mb"),
    )


@query
def q77_corrections(spark, d):
    """Corrections from JSON bodies: known names only, blanks dropped, numbers as texts, bodies that are none."""
    k = F.col("o_orderkey")
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('{"dias": '), k % 30, F.lit(', "otro": "x"}'))).when(k % 4 == 1, F.lit('{"numeroorden": " O-9 ", "cedula": " "}'))
        .when(k % 4 == 2, F.lit("no es JSON"))
    )
    own = mapper.with_corrections(table(spark, d, "orders").select("o_orderkey"), body)
    return own.select("o_orderkey", *[f"o_{n}" for n in ("cedula", "dias", "numeroorden", "tipo")])


@query
def q78_register(spark, d):
    """Claims registered at once as approved, rejected with or without a reason, or in a state that there isn't."""
    k = F.col("claim_id")
    asked = views.pick(("aprobado", "RECHAZADO", "Rechazado", "otro", None), k % 5)
    return review.register(_mapped(spark, d), asked, F.when(k % 5 == 1, F.lit("ilegible"))).select("claim_id", "code", "estado", "observaciones")


@query
def q79_insurer_large(spark, d):
    """Insurers by keyword from a catalogue too large for the plan: texts that hold a keyword with other words, in other letters, or
    none."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    said = F.when(k % 4 == 0, F.concat(F.lit("EPS "), F.upper(name), F.lit(" S.A."))).when(k % 4 == 1, name).when(k % 4 == 2, F.lit("otra entidad"))
    own = table(spark, d, "orders").select("o_orderkey", said.alias("said"))
    insurers = table(spark, d, "customer").select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("keyword"), F.lit(None).cast("string").alias("tax_id"), (F.col("c_nationkey") % 2 + 1).cast("int").alias("kind")
    )
    return resolve.insurer_by_keyword(own, insurers, F.col("said")).select("o_orderkey", "ins_id", "ins_kind", "ins_name")
