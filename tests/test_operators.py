"""Operators on small literal tables: cases, matching, reconciliation, mapping, review, intake."""

from datetime import date

import pytest
from foliospark import schema
from foliospark.operators import cases, mapper, merge, reconcile, report, resolve, review
from foliospark.plans import pipeline
from foliospark.sources import inbox, pages
from foliospark.streaming import intake
from pyspark.sql import functions as F

TODAY = date(2031, 6, 1)


@pytest.fixture
def dims(spark):
    return {
        "employees": spark.createDataFrame([(1, "80011122", "MARTA LUNA CLARA", "Solnorte EPS", True), (2, "90012345", "Luz Pradera Onda", "Faro", True), (3, "7", "Luz Pradera Onda", None, False)], schema.EMPLOYEES),
        "diagnoses": spark.createDataFrame([(1, "K42.9", "Hernia"), (2, "S42.0", "Fractura")], schema.DIAGNOSES),
        "insurers": spark.createDataFrame([(1, "SOL NORTE", None, 1), (2, "FARO", None, 2)], schema.INSURERS),
        "requirements": spark.createDataFrame([(1, 2, 3, "incapacidad", True), (2, 2, 3, "resumen", False)], schema.REQUIREMENTS),
    }


def test_names_and_cases(spark):
    paths = ["correo/80011122_INCAPACIDAD.pdf", "80011122-epicrisis-02.JPG", "whatsapp/80011122_Permiso_1.png", "original/1234_FURAT.pdf", "90012345_HISTORIA_CLINICA.pdf", "sin_nomenclatura/80011122_FURAT.pdf", "90012345_niñez.tiff", "notas.txt"]
    files = cases.inbox_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert files.count() == 6  # one kind of file is ignored, one folder is left alone
    parsed = cases.parse_names(files)
    good, stray = cases.split_names(parsed)
    assert {r["path"] for r in stray.collect()} == {paths[3], paths[4]}
    rows = {r["case_id"]: r for r in cases.cases(parsed).collect()}
    r = rows["80011122"]
    assert (r["present"], r["n_files"], r["n_base"], r["base"], r["channel"]) == (["EPICRISIS", "INCAPACIDAD", "PERMISO"], 3, 2, paths[0], "WHATSAPP")
    assert rows["90012345"]["base"] is None and rows["90012345"]["present"] == ["NIEZ"]
    counts = cases.inbox_counts(parsed).first()
    assert (counts["archivos"], counts["con_nomenclatura"], counts["sin_nomenclatura"], counts["casos"]) == (6, 4, 2, 2)


def test_page_text_and_cap(spark):
    rows = [("a", 2, "dos certificado de incapacidad"), ("a", 1, "uno"), ("b", 1, "x"), ("b", 2, None), ("b", 3, "z ")]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    got = {r["doc_id"]: r["text"] for r in cases.page_text(df, pages.is_relevant(F.col("text"))).collect()}
    assert got == {"a": "dos certificado de incapacidad", "b": "x\n\nz"}
    capped = cases.first_pages(df, 2).collect()
    assert {(r["doc_id"], r["page_no"], r["truncated"]) for r in capped} == {("a", 1, False), ("a", 2, False), ("b", 1, True), ("b", 2, True)}


def test_engine_faults_stay_with_their_pages(spark):
    def make():
        def run(batches):
            raise RuntimeError("no model")
            yield

        return run

    pages.register_engine("broken", make)
    df = spark.createDataFrame([("a", 1, b"x")], "doc_id string, page_no int, content binary")
    assert pages.document_text(pages.recognise(df, "broken")).first()["error"] == "no model"
    assert pages.document_text(pages.recognise(df, "stub")).first()["text"] == "x"
    with pytest.raises(ValueError):
        pages.engine("none")


def test_employee_chain(spark, dims):
    rows = [(1, "80.011.122", None), (2, "5", "LUZPRADERAONDA x"), (3, None, "Luz"), (4, None, "pradera onda"), (5, "", None)]
    df = spark.createDataFrame(rows, "id int, number string, name string")
    got = {r["id"]: r["emp_id"] for r in resolve.employee(df, dims["employees"], "id", F.col("number"), F.col("name")).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 2, 5: None}


@pytest.mark.parametrize("both", [True, False])
def test_indexed_containment_equals_comparison(spark, both):
    import random

    rng = random.Random(1)
    part = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    keys = [(k, part(rng.randint(0, 14))) for k in range(150)]
    reads = []
    for k in range(200):
        own = rng.choice(keys)[1]
        reads.append((k, rng.choice([part(rng.randint(0, 20)), part(3) + own + part(2), own[1:-1]])))
    catalogue, df = spark.createDataFrame(keys, "__order int, __key string"), spark.createDataFrame(reads, "__read int, __text string")
    want = {}
    for r, t in reads:
        hits = [k for k, own in keys if own and t and (own in t or (both and t in own))]
        if hits:
            want[r] = min(hits)
    for small in (10**6, 0):
        assert {r["__read"]: r["__order"] for r in resolve.containment(df, catalogue, both, small).collect()} == want


@pytest.mark.parametrize("longest, alphabet", [(60, "ab"), (40, "abc"), (3, "ab")])
def test_indexed_containment_of_many_lengths(spark, longest, alphabet):
    import random

    rng = random.Random(longest)
    part = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    keys = [(k, part(rng.randint(0, longest))) for k in range(120)]
    keys += [(k + 120, own) for k, own in keys[:40]]  # names that several hold
    reads = []
    for k in range(300):
        own = rng.choice(keys)[1]
        reads.append((k, rng.choice([part(rng.randint(0, longest + 9)), part(3) + own + part(2), own[1:-1], own[: len(own) // 2], own])))
    want = {r: min(hits) for r, t in reads if (hits := [k for k, own in keys if own and t and (own in t or t in own)])}
    catalogue, df = spark.createDataFrame(keys, "__order int, __key string"), spark.createDataFrame(reads, "__read int, __text string")
    assert {r["__read"]: r["__order"] for r in resolve.containment(df, catalogue, True, 0).collect()} == want


def _rows_of_joins(plan) -> list[tuple[str, int]]:
    """Name and rows of every join that a finished plan ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _rows_of_joins(plan.executedPlan())
    inner = [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = [(name, plan.metrics().apply("numOutputRows").value())] if "Join" in name else []
    return own + [x for p in inner for x in _rows_of_joins(p)]


def test_names_of_one_beginning_are_looked_up_once_and_never_broadcast(spark):
    n = 300
    people = spark.range(n).select(F.col("id").cast("int"), F.lit("").alias("id_number"), F.format_string("Customer#%09d", "id").alias("full_name"), F.lit("x").alias("insurer"))
    reads = spark.range(n).select("id", F.left(F.format_string("customer#%09d", "id"), F.lit(14)).alias("name"))  # every key holds every text
    defaults, resolve.containment.__defaults__ = resolve.containment.__defaults__, (0,)  # small
    try:
        got = resolve.employee_by_name(reads, people, "id", F.col("name"))
    finally:
        resolve.containment.__defaults__ = defaults
    frame = got._jdf.queryExecution().executedPlan()
    assert {tuple(r)[:2] for r in got.collect()} == {(k, 0) for k in range(n)}
    joins = _rows_of_joins(frame)
    assert joins and not [j for j in joins if "Broadcast" in j[0]]
    assert max(rows for _, rows in joins) <= n  # not the square of it


def test_insurers_too_many_for_the_plan_are_never_broadcast(spark):
    n = resolve.SMALL + 50
    insurers = spark.range(n).select(F.col("id").cast("int"), F.format_string("Faro#%09d", "id").alias("keyword"), F.lit(None).cast("string").alias("tax_id"), F.lit(1).alias("kind"))
    own = spark.range(3 * n).select("id", F.format_string("EPS FARO#%09d S.A.", F.col("id")).alias("said"))
    got = resolve.insurer_by_keyword(own, insurers, F.col("said"))
    frame = got._jdf.queryExecution().executedPlan()
    assert {r["id"]: r["ins_id"] for r in got.collect()} == {k: k if k < n else None for k in range(3 * n)}
    joins = _rows_of_joins(frame)
    assert joins and not [j for j in joins if "Broadcast" in j[0]]


def test_insurer_chain(spark, dims):
    rows = [(1, "EPS SOLNORTE", None, True), (2, "?", "faro sur", True), (3, "SOAT FARO", "sol norte", True), (4, None, None, True), (5, "FARO", "FARO", False), (6, "soat", None, True)]
    df = spark.createDataFrame(rows, "id int, t string, e string, applies boolean")
    for tiny in (resolve.TINY, -1):  # as part of the plan, and by a join
        resolve_tiny, resolve.TINY = resolve.TINY, tiny
        try:
            got = {r["id"]: r for r in resolve.insurer(df, dims["insurers"], F.col("t"), F.col("e"), F.col("applies")).collect()}
        finally:
            resolve.TINY = resolve_tiny
        assert {k: (r["ins_id"], r["ins_kind"], r["ins_from_employee"], r["ins_unknown"]) for k, r in got.items()} == {
            1: (1, 1, False, False), 2: (2, 2, True, False), 3: (1, 1, True, False), 4: (1, 1, False, True), 5: (None, None, False, False), 6: (1, 1, False, True),
        }
    none = resolve.insurer(df, dims["insurers"].limit(0), F.col("t"), F.col("e"), F.col("applies")).collect()
    assert all(r["ins_unknown"] == r["applies"] for r in none)


D = lambda n: date(2031, 1, n)


@pytest.mark.parametrize(
    "given, want",
    [
        ((D(1), None, 5, False), (D(1), D(5), 5, False)), ((D(1), D(9), 5, False), (D(1), D(5), 5, False)), ((None, D(9), 5, False), (D(5), D(9), 5, True)),
        ((D(1), D(9), None, False), (D(1), D(9), 9, False)), ((D(1), D(9), 900, False), (D(1), D(9), 9, False)), ((D(9), D(1), None, False), (None, D(1), None, False)),
        ((D(9), D(1), None, True), (D(9), None, None, False)), ((None, None, 700, False), (None, None, 700, False)), ((D(1), None, None, True), (D(1), None, None, False)),
    ],
)
def test_reconcile_and_again(spark, given, want):
    df = spark.createDataFrame([given], "s date, e date, n int, held boolean")
    once = reconcile.reconcile(df, "s", "e", "n", F.col("held"), "calc")
    r = once.first()
    assert (r["s"], r["e"], r["n"], r["calc"]) == want
    again = reconcile.reconcile(once.drop("calc"), "s", "e", "n", F.col("held"), "calc").first()
    assert (again["s"], again["e"], again["n"]) == want[:3]


def case(spark, **values):
    base = {"case_id": "c", "text": "", "channel": "correo", "source": "f.pdf", "ocr_backend": "stub", "extractor": "rule-based"}
    record = {k: F.lit(v) for k, v in values.pop("record", {}).items()}
    present = values.pop("present", ["INCAPACIDAD", "EPICRISIS"])
    df = spark.createDataFrame([tuple((base | values).values())], ", ".join(f"{k} string" for k in base | values))
    array = F.lit(None).cast("array<string>") if present is None else F.array(*[F.lit(p) for p in present])
    return df.withColumns({"record": schema.record(record), "present": array})


FULL = {"paciente.documento_numero": "80011122", "diagnostico.cie10": "K429", "entidad.eps": "SOLNORTE", "incapacidad.fecha_inicio": D(1), "incapacidad.dias": 3}


def test_mapping_of_a_full_case(spark, dims):
    r = mapper.map_to_staging(case(spark, record=FULL), dims, TODAY).first()
    assert (r["idlpempleado"], r["idlpdiagnosticos"], r["idlpentidad"], r["idlptipoausentismo"], r["idlpnivelincapacidad"]) == (1, 1, 1, 3, 9)
    assert (r["fechavencimiento"], r["problemas"], r["needs_review"], r["documentacion_estado"]) == (D(4), None, False, "COMPLETA")
    assert r["observaciones"] == "ENFERMEDAD GENERAL | DX K429 - Hernia"
    assert (float(r["confianza_ocr"]), r["paciente_leido"], r["original"], r["idlpestadosrecepausentismos"]) == (1.0, "MARTA LUNA CLARA", 0, 3)


def test_problems_come_in_order(spark, dims):
    r = mapper.map_to_staging(case(spark, present=["FURAT"]), dims, TODAY).first()
    assert r["problems"] == [mapper.NO_NUMBER, mapper.NO_CODE, mapper.NO_INSURER, mapper.NO_START, mapper.NO_DAYS, "Faltan documentos requeridos: INCAPACIDAD, EPICRISIS"]
    assert [f["campo"] for f in r["missing_fields"]] == ["cedula", "cie10", "eps", "fecha_inicio", "dias"]
    r = mapper.map_to_staging(case(spark, record={**FULL, "incapacidad.dias": 900, "paciente.documento_numero": "5", "diagnostico.cie10": "Z99"}), dims, TODAY).first()
    assert r["problems"] == ["Cédula 5 no encontrada en empleados", "Diagnóstico Z99 no está en el catálogo CIE-10", "Número de días fuera de rango (=900)"]


def test_corrections_win(spark, dims):
    r = mapper.map_to_staging(case(spark, record=FULL, o_cedula="90012345", o_tipo="5", o_dias=" 4 ", o_fecha_inicio="2031-03-01", o_nivel="2", o_eps=""), dims, TODAY).first()
    assert (r["idlpempleado"], r["idlptipoausentismo"], r["Numerodias"], r["fechainicio"], r["idlpnivelincapacidad"], r["idlpentidad"]) == (2, 5, 4, date(2031, 3, 1), 2, 1)
    r = mapper.map_to_staging(case(spark, record=FULL, o_fecha_inicio="2031-02-31", o_tipo="99"), dims, TODAY).first()
    assert (r["fechainicio"], r["idlptipoausentismo"]) == (None, 3)


def test_permits_holidays_and_uploads(spark, dims):
    permit = {"tipo_documento": "permiso", "permiso.tipo_remunerado": "NO_REMUNERADO", "paciente.documento_numero": "80011122", "incapacidad.fecha_inicio": D(1), "incapacidad.dias": 1, "permiso.horas_total": "3"}
    r = mapper.map_to_staging(case(spark, record=permit, present=["PERMISO"]), dims, TODAY).first()
    assert (r["idlptipoausentismo"], r["idlpentidad"], r["idlpnivelincapacidad"], r["problemas"]) == (7, None, None, None)
    assert r["observaciones"] == "LICENCIA NO REMUNERADA | Horas: ?-? (3h)"
    r = mapper.map_to_staging(case(spark, record={"tipo_documento": "permiso"}, present=[]), dims, TODAY).first()
    assert r["problems"][0] == mapper.NO_PERMIT_KIND and r["documentos_faltantes"] == "PERMISO"
    r = mapper.map_to_staging(case(spark, record={**FULL, "tipo_documento": "vacaciones"}, present=None), dims, TODAY).first()
    assert (r["idlptipoausentismo"], r["codigo_diagnostico_leido"], r["documentacion_estado"]) == (13, None, "COMPLETA")
    r = mapper.map_to_staging(case(spark, record={**FULL, "entidad.eps": "FARO"}, present=None), dims, TODAY).first()
    assert (r["documentos_faltantes"], r["documentacion_estado"], r["needs_review"]) == ("RESUMEN_ATENCION", "INCOMPLETA", False)


def test_no_catalogues(spark, dims):
    r = mapper.map_to_staging(case(spark, record=FULL), {k: v.limit(0) for k, v in dims.items()}, TODAY).first()
    assert (r["idlpempleado"], r["idlpdiagnosticos"], r["idlpentidad"]) == (None, None, 1)
    assert len(r["problems"]) == 3


def test_merge_keeps_sections_apart(spark):
    rule = schema.record({"tipo_documento": F.lit("vacaciones"), "paciente.documento_numero": F.lit("1"), "incapacidad.fecha_inicio": F.lit(D(1)), "incapacidad.dias": F.lit(2), "incapacidad.inicio_anclada": F.lit(True)})
    model = schema.record({"paciente.documento_numero": F.lit("2"), "paciente.nombre": F.lit("Ana"), "incapacidad.fecha_inicio": F.lit(D(2)), "incapacidad.fecha_fin": F.lit(D(9)), "incapacidad.dias": F.lit(5), "incapacidad.origen": F.lit("x9")})
    df = spark.range(1).select(rule.alias("r"), model.alias("m"), F.lit("del 2031-01-01").alias("t"))
    got = merge.merge(df, "r", "m", F.lit(False), F.col("t")).first()["record"]
    assert (got["tipo_documento"], got["paciente"]["documento_numero"], got["paciente"]["nombre"]) == ("vacaciones", "1", "Ana")
    assert (got["incapacidad"]["fecha_inicio"], got["incapacidad"]["fecha_fin"], got["incapacidad"]["dias"], got["incapacidad"]["origen"]) == (D(1), None, 2, None)
    assert merge.merge(df, "r", "m", F.lit(None).cast("boolean"), F.col("t")).first()["record"]["paciente"]["nombre"] is None


STAGED = "id bigint, estado string, idlpempleado int, idlpdiagnosticos int, idlptipoausentismo int, fechainicio date, Numerodias int, observaciones string, problemas string"


def test_review(spark):
    rows = [(1, "PENDIENTE_REVISION", 1, 1, 3, D(1), 2, None, None), (2, "PENDIENTE_REVISION", 1, None, 12, D(1), 2, "nota", None), (3, "PENDIENTE_REVISION", None, 1, 3, None, 0, None, "p")]
    staging = spark.createDataFrame(rows, STAGED)
    asked = [(1, "aprobar", False), (2, "aprobar", False), (3, "aprobar", True), (3, "rechazar", False), (9, "aprobar", False), (1, "guardar", False), (1, "guardar", True), (1, "x", False)]
    requests = spark.createDataFrame(asked, "id bigint, action string, has_body boolean")
    code = lambda strict: {(r["id"], r["action"], r["code"]) for r in review.decide(staging, requests, strict).collect()}
    both = {(1, "aprobar", 200), (3, "aprobar", 409), (3, "rechazar", 200), (9, "aprobar", 404), (1, "guardar", 400), (1, "guardar", 200), (1, "x", 400)}
    assert code(True) == both | {(2, "aprobar", 409)}
    assert code(False) == both | {(2, "aprobar", 200)}
    updates = spark.createDataFrame([(2, "APROBADO", "visto", 7), (9, "APROBADO", None, 1)], "id bigint, state string, note string, Numerodias int")
    got = {r["id"]: r for r in review.apply_review(staging, updates).collect()}
    assert len(got) == 3 and (got[2]["estado"], got[2]["Numerodias"], got[2]["observaciones"]) == ("APROBADO", 7, "nota | visto")
    got = {r["id"]: r for r in review.set_state(staging, updates.withColumn("id", F.lit(1))).limit(9).collect()}
    assert got[2]["estado"] == "PENDIENTE_REVISION"
    assert review.latest(staging, "pendiente_revision", 2, ("id",)).collect()[0]["id"] == 3


def test_upsert_and_accuracy(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    assert {tuple(r) for r in review.upsert(old, new, "k", "at").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    df = spark.createDataFrame([("x", "XY", None), ("q", "z", "q")], "v string, t string, u string")
    scored = df.select(report.agrees(F.col("v"), F.col("t")).alias("a"), report.agrees(F.col("v"), F.col("u")).alias("b"))
    assert tuple(report.accuracy(scored, ["a", "b"]).first()) == (2, 3, 67.0)


def test_inbox_to_staging_and_again(spark, dims, tmp_path):
    """Files of five cases and a stray one, drained as a stream, twice."""
    root = tmp_path / "inbox"
    (root / "correo").mkdir(parents=True)
    certificate = "CERTIFICADO DE INCAPACIDAD MEDICA\nEPS FARO\nDocumento: CC {}\nDesde 2031-02-04 hasta 2031-02-06\nDiagnostico: K42.9 Hernia\n"
    for name, body in {
        "correo/90012345_INCAPACIDAD.pdf": certificate.format("90012345"), "90012345_RESUMEN.pdf": "x", "80011122_INCAPACIDAD_1.pdf": certificate.format("111222333"),
        "80011122_INCAPACIDAD_2.pdf": "x", "555555_FURAT.png": "x", "IMG_1.jpg": "x", "notes.txt": "x",
    }.items():
        (root / name).write_text(body)
    out, texts = str(tmp_path / "staging"), {}

    def handle(files, batch):
        own = files.select("path", "full_path")
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select(F.col("path").alias("p"), "content")
        content = own.join(read, F.col("full_path") == F.col("p")).select(F.col("path").alias("doc_id"), F.lit(1).alias("page_no"), "content")
        text = pages.document_text(pages.recognise(content)).withColumnRenamed("doc_id", "path")
        mapped, stray = pipeline.process_cases(files, text, dims, TODAY)
        texts["stray"] = [r["path"] for r in stray.collect()]
        intake.append_new(pipeline.staged(mapped), out)

    assert intake.drain(spark, str(root), str(tmp_path / "state"), handle) == 1
    assert texts["stray"] == ["IMG_1.jpg"]
    rows = {r["case_id"]: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {"90012345", "80011122", "555555"}
    assert (rows["90012345"]["documentacion_estado"], rows["90012345"]["problemas"], rows["90012345"]["channel"]) == ("COMPLETA", None, "WHATSAPP")
    assert "≠ leída (111222333)" in rows["80011122"]["problemas"] and "Hay 2 documentos base" in rows["80011122"]["problemas"]
    assert rows["555555"]["documentos_faltantes"] == "INCAPACIDAD, EPICRISIS"
    assert intake.drain(spark, str(root), str(tmp_path / "state"), handle) == 0
    handle(inbox.read_inbox(spark, str(root)), 9)  # the same files again add nothing
    assert spark.read.parquet(out).count() == 3
    assert inbox.read_inbox(spark, str(tmp_path / "none")).count() == 0


def test_hybrid_extractor_falls_back(spark):
    text = "CERTIFICADO DE INCAPACIDAD MEDICA CC 80011122; desde: 2031-02-04, hasta: 2031-02-06"
    replies = [(1, text, '{"paciente": {"nombre": "Ana"}, "incapacidad": {"fecha_inicio": "2031-02-05"}}'), (2, text, "nada"), (3, text, None)]
    df = spark.createDataFrame(replies, "id int, text string, reply string")
    got = {r["id"]: r["record"] for r in pipeline.extract(df, pipeline.extractor_named("hibrido", "reply")).collect()}
    assert got[1]["paciente"]["nombre"] == "Ana" and got[2]["paciente"]["nombre"] is None
    assert all(r["incapacidad"]["fecha_inicio"] == date(2031, 2, 4) and r["incapacidad"]["dias"] == 3 for r in got.values())


def test_routes_and_alerts(spark):
    rows = [("a/1_x.pdf", "1", "ANA LUZ", D(3), True, False), ("b/1_x.pdf", "1", "ANA LUZ", D(3), True, False), ("q.pdf", None, None, None, False, False), ("2_y.pdf", "2", None, None, False, False), ("3_z.pdf", "3", None, None, False, True)]
    df = spark.createDataFrame(rows, "path string, n string, p string, s date, ok boolean, bad boolean")
    got = {r["path"]: (r["dest"], r["collision"]) for r in review.routes(df, F.col("ok"), F.col("bad"), F.col("p"), F.col("n"), F.col("s")).collect()}
    assert got["a/1_x.pdf"] == ("procesados/ANA LUZ/2031/01/03/1_x.pdf", True)
    assert got["q.pdf"] == ("inbox/sin_nomenclatura/q.pdf", False)
    assert got["2_y.pdf"][0] == "incompletos/SIN NOMBRE 2/sin_fecha/2_y.pdf" and got["3_z.pdf"][0] == "cuarentena/3/3_z.pdf"


def test_catalogue_tables_and_command_line(spark, tmp_path):
    from foliospark import cli
    from foliospark.sources import catalog

    name = "folio_test"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    try:
        catalog.create_tables(spark, name)
        spark.sql(f"INSERT INTO {name}.lpempleados VALUES (1, '80011122', 'MARTA LUNA', 'FARO', false)")
        assert spark.table("vlpempleados").first()["nombrecompleto"] == "MARTA LUNA"
        assert spark.table(f"{name}.lpnivelincapacidad").count() == 14
        dims, there = catalog.dims_or_empty(spark, lambda: catalog.dims_of_tables(spark, name))
        assert there and dims["employees"].count() == 1
        dims, there = catalog.dims_or_empty(spark, lambda: catalog.dims_of_tables(spark, "no_such_database"))
        assert not there and dims["employees"].count() == 0
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "80011122_INCAPACIDAD.pdf").write_text("CERTIFICADO DE INCAPACIDAD MEDICA CC 80011122; desde: 2031-02-04, hasta: 2031-02-06")
        (tmp_path / "in" / "odd.pdf").write_text("x")
        assert list(cli.main([str(tmp_path / "in"), "--text-only"], spark)) == ["80011122_INCAPACIDAD.pdf"]
        done = cli.main([str(tmp_path / "in"), "--database", name, "--out", str(tmp_path / "out")], spark)
        assert (done["casos_total"], done["sin_nomenclatura"], done["cuarentena"], done["catalogue"]) == (1, 1, 0, True)
        assert spark.read.parquet(str(tmp_path / "out")).first()["idlpempleado"] == 1
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
