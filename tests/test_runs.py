"""Models behind HTTP, runs one at a time, moves of files; labels as recognition may give them."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from foliospark.functions import forms
from foliospark.plans import pipeline
from foliospark.sources import pages, remote
from foliospark.streaming import runs
from pyspark.sql import functions as F

TEXT = "CERTIFICADO DE INCAPACIDAD MEDICA CC 8001112{}; desde: 2031-02-04, hasta: 2031-02-06"


@pytest.fixture(scope="module")
def server():
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            message = asked["messages"][0]
            if asked["model"] == "none" or "80011125" in message["content"]:
                return self.send_error(404 if asked["model"] == "none" else 500)
            said = json.dumps({"paciente": {"nombre": "Ana Luz"}}) if asked.get("format") == "json" else f"page of {len(message['images'][0])} letters"
            assert asked["options"] == {"temperature": 0.0} and asked["stream"] is False
            body = json.dumps({"message": {"content": said}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    own = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/"
    own.shutdown()


def test_a_vision_model_reads_pages(spark, server):
    remote.register_vision(server, "eyes", "ollama")
    remote.register_vision(server, "none", "missing")
    remote.register_vision("http://127.0.0.1:9", "eyes", "away")
    df = spark.createDataFrame([("a", 1, b"abc"), ("a", 2, b"abcdef")], "doc_id string, page_no int, content binary")
    assert pages.document_text(pages.recognise(df, "ollama")).first()["text"] == "page of 4 letters\npage of 8 letters"
    assert pages.document_text(pages.recognise(df, "missing")).first()["error"] == "model not available: none"
    assert "can't be reached" in pages.document_text(pages.recognise(df, "away")).first()["error"]


def test_a_model_reads_records_and_may_fail(spark, server):
    texts = spark.createDataFrame([(str(k), TEXT.format(k)) for k in (4, 5)] + [("6", None)], "path string, text string")
    asked = remote.replies(texts, remote.record_reader(server, "reader"))
    got = {r["path"]: r["record"]["paciente"] for r in pipeline.extract(asked, pipeline.extractor_named("hibrido", "reply")).collect()}
    assert (got["4"]["nombre"], got["4"]["documento_numero"]) == ("Ana Luz", "80011124")
    assert (got["5"]["nombre"], got["5"]["documento_numero"]) == (None, "80011125")  # rules alone
    assert got["6"]["documento_numero"] is None


def test_one_run_at_a_time(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    assert runs.state(spark, folder) == {"running": False}
    with runs.one_at_a_time(spark, folder) as result:
        result["cases"] = 3
        assert runs.state(spark, folder)["running"]
        with pytest.raises(runs.Busy), runs.one_at_a_time(spark, folder):
            pass
    done = runs.state(spark, folder)
    assert not done["running"] and done["result"] == {"cases": 3} and done["ended"] >= done["began"]
    with pytest.raises(KeyError), runs.one_at_a_time(spark, folder):
        raise KeyError("a fault")
    assert runs.state(spark, folder) == done  # the lock is gone, the last good run's state stays


def test_moves_follow_the_manifest(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / name).write_text(name)
    rows = [("a.pdf", "procesados/ANA/2031/a.pdf"), ("b.pdf", "procesados/ANA/2031/a.pdf"), ("x.pdf", "cuarentena/x.pdf"), ("c.pdf", "c.pdf")]
    moves = spark.createDataFrame(rows, "path string, dest string").coalesce(1)
    assert runs.move_files(moves, f"file://{tmp_path}") == {"moved": 1, "gone": 1, "taken": 1}
    assert (tmp_path / "procesados/ANA/2031/a.pdf").read_text() == "a.pdf" and (tmp_path / "b.pdf").exists() and (tmp_path / "c.pdf").exists()


@pytest.mark.parametrize(
    "phrases, yes, no",
    [
        (("fecha [de] inici*",), ["FECHAINICIO", "Fecha de lnicio", "fecha  inicial", "fecha\ninicia"], ["fecha fin", "inicio"]),
        (("<ips afiliado>",), ["IPS Afiliado", "IIPSAfiliado", "lps_afiliado"], ["CLIPS afiliado", "ips"]),
        (("reg. med", "tarjeta profesional"), ["Reg. Med", "REGMED", "tarjetaprofesional"], ["registro"]),
        (("cédula",), [], ["cedula"]),
        (("cedula",), ["CÉDULA", "cedula"], ["cdula"]),
        (("accidente +",), ["accidente laboral", "ACCIDENTE DE"], ["accidente 7"]),
    ],
)
def test_labels(spark, phrases, yes, no):
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", F.col("t").rlike("(?iUd)" + forms.label(*phrases)).alias("r")).collect()
    assert {r["t"] for r in rows if r["r"]} == set(yes)


def test_shapes_of_values():
    assert re.fullmatch(forms.initials("cc", "ti").replace("\\s?", r"\s?"), "c. c.") and re.fullmatch(forms.initials("am"), "a.m.")
    assert forms.digits(2, 4) == "[0-9]{2,4}"
