"""Column functions on small literal rows."""

from datetime import date

import pytest
from foliospark.functions import codes, dates, names, replies, text
from pyspark.sql import functions as F


@pytest.fixture
def value(spark):
    """Evaluates a function of a column on one value."""

    def run(f, v, kind="string"):
        return spark.createDataFrame([(v,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]

    return run


@pytest.mark.parametrize("raw, want", [(" Ñandú  ÁÉ x ", "nandu ae x"), (None, ""), ("é", "e"), ("A\tB", "a b")])
def test_fold(value, raw, want):
    assert value(text.fold, raw) == want


def test_labels_ignore_case_and_accents_in_capitals(value):
    assert value(lambda c: text.find(c, text.IU + r"expedici[oó]n\s*:\s*(\w+)"), "EXPEDICIÓN: ñu") == "ñu"
    assert value(lambda c: text.near(c, "valor", r"([0-9]+)", 6), "VALOR abc 12345") == "1"
    assert value(lambda c: text.after_each(c, "cargo", 20), "cargo: uno\ncargo -\n\n dos\nCARGO") == ["uno", "dos"]


@pytest.mark.parametrize(
    "path, want", [("a/b.X.PDF", ("b.X", ".pdf")), ("b", ("b", "")), (".hidden", (".hidden", "")), ("x/12_TIPO.tiff", ("12_TIPO", ".tiff"))]
)
def test_paths(value, path, want):
    assert (value(text.stem, path), value(text.suffix, path)) == want


def test_safe_folder(value):
    assert value(text.safe_folder, ' Ána: "Bé"/x. ') == "Ana Be x"
    assert len(value(text.safe_folder, "x" * 99)) == 60


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2031-02-28", date(2031, 2, 28)), ("2031-02-30", None), ("1/2/2031", date(2031, 2, 1)), ("31-12-2031", date(2031, 12, 31)),
        ("10-jun-31", date(2031, 6, 10)), ("10jun31", date(2031, 6, 10)), ("5 Set.2031", date(2031, 9, 5)), ("10-xyz-31", None), ("2031-2-3", None),
        ("", None), (None, None), ("54/01/2031", None), (" 3/4/2031 ", date(2031, 4, 3)), ("1 ene 031", None),
    ],
)
def test_any_date(value, raw, want):
    assert value(dates.any_date, raw) == want


def test_labelled_dates(value):
    start = lambda c: dates.labelled_date(c, r"fecha\s*inicio")
    assert value(start, "Fecha Inicio:\n 2031-01-05") == date(2031, 1, 5)
    assert value(start, "2031-01-05\nFecha Inicio") == date(2031, 1, 5)
    assert value(start, "Fecha Fin:2031-01-05\nFecha Inicio: ninguna") is None  # the date is another label's
    assert value(start, "2031-01-04 Fecha Inicio 2031-02-31") is None  # what stands after the label counts, valid or not
    assert value(lambda c: dates.labelled_date_or_triplet(c, "dia"), "dia 06 07 31") == date(2031, 7, 6)
    assert value(dates.dates_in, "de 1/2/2031 a 2031-02-01 y 31/02/2031") == [date(2031, 2, 1)]


def test_written_dates(value):
    t = "Fecha Inicio Tipo VIERNES 10 DEJULIO JUEVES23DEJULIO DE 2031 DE 2031"
    assert value(dates.written_dates, t) == [date(2031, 7, 10), date(2031, 7, 23)]
    assert value(dates.written_dates, "10 DE JULIO DE 2031") is None


def test_days(spark):
    rows = [(date(2031, 1, 1), date(2031, 1, 1), 1), (date(2031, 1, 2), date(2031, 1, 1), None), (date(2031, 1, 1), date(2032, 6, 23), 540), (date(2031, 1, 1), date(2032, 6, 24), None)]
    df = spark.createDataFrame(rows, "s date, e date, n int")
    assert [r["x"] for r in df.select(dates.days_between(F.col("s"), F.col("e")).alias("x")).collect()] == [r[2] for r in rows]
    assert [r["x"] for r in df.select(dates.due_date(F.col("s"), F.col("n")).alias("x")).collect()][0] == date(2031, 1, 2)


@pytest.mark.parametrize("raw, want", [("12", 12), (" 7 ", 7), ("x", None), ("1.5", None), ("-3", None), (None, None), ("", None), ("99999999999", None)])
def test_day_count(value, raw, want):
    assert value(dates.day_count, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("historia", "HISTORIA_CLINICA"), ("Nacido-Vivo", "CERTIFICADO_NACIDO_VIVO"), ("furat1", "FURAT"), ("raro", "RARO"), ("ñ", None), ("12", None), (None, None)],
)
def test_canonical_document_and_again(value, raw, want):
    assert value(codes.canonical_document, raw) == want
    assert value(lambda c: codes.canonical_document(codes.canonical_document(c)), raw) == want


@pytest.mark.parametrize("raw, code, fixes", [("s420", "S42.0", 0), ("A09", "A09", 0), ("K4O,I", "K40.1", 2), ("kIO|", "K10.1", 3), ("0420", None, 99), ("S4", None, 99), (None, None, 99)])
def test_diagnosis_code(value, raw, code, fixes):
    assert value(codes.diagnosis_code, raw) == code
    assert value(codes.diagnosis_fixes, raw) == fixes


def test_best_diagnosis(value):
    assert value(codes.best_diagnosis, "A09 texto. Diagnostico: S42LX y K42.9") == "K42.9"  # fewer letters put right wins among those by a label
    assert value(codes.best_diagnosis, "M54 luego A09") == "M54"
    assert value(codes.best_diagnosis, "SOL y FOS") is None
    far = "dx" + " " * 60 + "A09"
    assert value(codes.best_diagnosis, far + " cie10 B20") == "B20"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Accidente en el TRABAJO", 2), ("accidente laboral", 2), ("enfermedad laboral", 8), ("Licencia de MATERNIDAD", 5), ("paternidad", 9),
        ("prelicencia", 10), ("Tránsito", 11), ("comun", 3), ("", 3), (None, 3),
    ],
)
def test_type_of_text(value, raw, want):
    assert value(codes.type_of_text, raw) == want


@pytest.mark.parametrize(
    "raw, want", [("accidente de trabajo x", "Accidente de trabajo"), ("COMÚN", "Común"), ("Enfermedad general", "Enfermedad general"), ("A 12", None), ("z" * 31, None), (" otra ", "otra"), (" ", None)]
)
def test_clean_origin(value, raw, want):
    assert value(codes.clean_origin, raw) == want


def test_missing_documents(spark):
    df = spark.createDataFrame([(["INCAPACIDAD", "EPICRISIS"], ["HISTORIA_CLINICA"]), (["FURAT", "FURAT"], []), (["REGISTRO_CIVIL_NACIMIENTO"], ["CERTIFICADO_NACIDO_VIVO"])], "r array<string>, p array<string>")
    assert [r["m"] for r in df.select(codes.missing_documents(F.col("r"), F.col("p")).alias("m")).collect()] == [["INCAPACIDAD"], ["FURAT", "FURAT"], []]


LEXICON = {"SOLAR", "MARINA", "LUNA", "MAR", "INA", "CLARA"}


@pytest.mark.parametrize("word, want", [("MARINASOLAR", ["MARINA", "SOLAR"]), ("MARINA", ["MARINA"]), ("SOLARX", None), ("", None), ("MARINAMARINA", ["MARINA", "MARINA"])])
def test_split_word(word, want):
    assert names.split_word(word, LEXICON) == want


def test_names(spark):
    df = spark.createDataFrame([("LunaClaraSolar  marina R",), ("ANA LUNA edad 30",), (None,), (" .: ",)], "n string")
    assert [r["x"] for r in df.select(names.clean_name(F.col("n"), LEXICON).alias("x")).collect()] == ["Luna Clara Solar marina", "ANA LUNA", None, None]
    df = spark.createDataFrame([("ANA LUZ MAR SOL",), ("ANA",), ("ANA LUZ",), ("",), (None,), ("ANA LUZ  LUZ",)], "n string")
    assert [r["x"] for r in df.select(names.short_name(F.col("n"), ["Luz"]).alias("x")).collect()] == ["ANA MAR", "ANA", "ANA LUZ", None, None, "ANA LUZ"]


@pytest.mark.parametrize(
    "raw, want, failed",
    [('```json\n{"a": 1}\n```', '{"a": 1}', False), ('dice {"a": 1} fin', '{"a": 1}', False), ("nada", None, True), ('{"error": "x"}', '{"error": "x"}', True), ("[1]", "[1]", True), (None, None, True)],
)
def test_replies(value, raw, want, failed):
    assert value(replies.json_text, raw) == want
    assert value(replies.reply_failed, raw) is failed


def test_a_text_is_cut_at_its_candidates_once_for_all_of_them(spark):
    df = spark.createDataFrame([("Dx K42.9, no S4Z ni SOL; principal: B0l. A1O23 " * 5,)], "text string").select(codes.best_diagnosis(F.col("text")).alias("code"))
    assert df.first()["code"] == "K42.9"
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 2  # pieces and candidates; what is named in the lambda is made for each of them
