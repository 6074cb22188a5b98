"""Documents to pages to text: renderers, faults that stay with their document, engines that see each page once, the command line."""

import json
import struct

import pandas as pd
import pytest
from foliospark import cli
from foliospark.plans import pipeline
from foliospark.sources import catalog, pages, render
from pyspark.sql import functions as F

CERTIFICATE = "CERTIFICADO DE INCAPACIDAD MEDICA CC {}; desde: 2031-02-04, hasta: 2031-02-06"


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\x00\x00\x00"


def jpeg(width, height):
    return b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + b"\x01"


def bmp(width, height):
    return b"BM" + b"\0" * 16 + struct.pack("<ii", width, -height)


@pytest.mark.parametrize("make", [png, jpeg, bmp])
def test_picture_sizes(make):
    assert render.picture_size(make(300, 200)) == (300, 200)
    assert render.picture_size(b"plain text") is None and render.picture_size(b"\xff\xd8\xff") is None


def test_pages_by_kind_of_file(spark):
    def make():
        return lambda content: (bytes([c]) for c in content)  # a page for each byte

    render.register_renderer(".many", make)
    rows = [("a", "a.many", b"xyz"), ("b", "b.png", png(10, 10)), ("c", "c.JPG", jpeg(60_000, 50_000)), ("d", "d.pdf", b"%PDF-1.7"), ("e", "e.pdf", b"text"), ("f", "f.odd", b"x"), ("g", "g.many", None)]
    df = spark.createDataFrame(rows, "doc_id string, name string, content binary")
    got = {(r["doc_id"], r["page_no"]): r for r in render.render(df, 1).collect()}
    assert [bytes(got["a", k]["content"]) for k in (1, 2)] == [b"x", b"y"] and ("a", 3) not in got  # one page over the cap shows it
    assert bytes(got["b", 1]["content"]) == png(10, 10) and bytes(got["e", 1]["content"]) == b"text"
    assert "60000 x 50000" in got["c", 1]["error"] and ".pdf" in got["d", 1]["error"] and ".odd" in got["f", 1]["error"] and got["g", 1]["error"]
    texts = {r["doc_id"]: r for r in pages.document_text(pages.recognise(render.render(df))).collect()}
    assert texts["a"]["text"] == "x\ny\nz" and texts["e"]["text"] == "text" and texts["d"]["text"] is None and ".pdf" in texts["d"]["error"]


def test_an_engine_sees_each_page_once_and_fails_alone(spark, tmp_path):
    log = str(tmp_path / "seen")

    def make():
        def run(batches):
            for rows in batches:
                with open(log, "a") as out:
                    out.writelines(f"{d} {n}\n" for d, n in zip(rows["doc_id"], rows["page_no"]))
                yield pd.DataFrame({"doc_id": rows["doc_id"], "page_no": rows["page_no"], "text": "ok text of the page", "error": None})
                if (rows["doc_id"] == "d7").any():  # after a partial result
                    raise RuntimeError("bad page")

        return run

    pages.register_engine("counting", make)
    rows = [(f"d{k}", n, b"x") for k in range(20) for n in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, content binary").repartition(2)
    texts = pages.document_text(pages.recognise(df, "counting"))
    got = {r["doc_id"]: r for r in pipeline.extract(texts).select("doc_id", "error", "note").collect()}
    assert [d for d, r in got.items() if r["error"]] == ["d7"] and len(got) == 20 and got["d7"]["note"]
    seen = open(log).read().split("\n")[:-1]
    assert sorted(seen) == sorted(f"d{k} {n}" for k in range(20) for n in (1, 2))


def test_the_command_line_opens_only_the_batch(spark, tmp_path):
    log, root = str(tmp_path / "seen"), tmp_path / "in"

    def make():
        def run(batches):
            for rows in batches:
                with open(log, "a") as out:
                    out.writelines(f"{d}\n" for d in rows["doc_id"])
                yield pd.DataFrame({"doc_id": rows["doc_id"], "page_no": rows["page_no"], "text": [bytes(c).decode() for c in rows["content"]], "error": None})

        return run

    pages.register_engine("logging", make)
    root.mkdir()
    for k in range(6):
        (root / f"8001112{k}_INCAPACIDAD.pdf").write_text(CERTIFICATE.format(f"8001112{k}"))
    out = str(tmp_path / "out")
    done = cli.main([str(root), "--engine", "logging", "--limit", "2", "--out", out, "--dry-run"], spark)
    assert done["casos_total"] == 2 and not (tmp_path / "out").exists()
    assert sorted(set(open(log).read().split())) == ["80011120_INCAPACIDAD.pdf", "80011121_INCAPACIDAD.pdf"]
    replies = str(tmp_path / "replies")
    answer = json.dumps({"paciente": {"nombre": "Ana Luz"}})
    spark.createDataFrame([("80011120_INCAPACIDAD.pdf", answer)], "path string, reply string").write.parquet(replies)
    cli.main([str(root), "--engine", "logging", "--limit", "2", "--out", out, "--extractor", "hibrido", "--replies", replies], spark)
    rows = {r["cedula_leida"]: r for r in spark.read.parquet(out).collect()}
    assert {r["ocr_backend"] for r in rows.values()} == {"logging"} and {r["extractor"] for r in rows.values()} == {"hibrido"}
    assert rows["80011120"]["paciente_leido"] == "Ana Luz" and rows["80011121"]["paciente_leido"] is None
    one = cli.main([str(root), "--json", "80011123_INCAPACIDAD.pdf"], spark)
    assert one["record"]["paciente"]["documento_numero"] == "80011123" and one["error"] is None
    assert cli.main([str(root), "--text-only", "--out", str(tmp_path / "texts")], spark) == {"texts": 6}


def test_only_an_absent_catalogue_is_empty(spark):
    def bug():
        raise KeyError("a fault in the loader")

    with pytest.raises(KeyError):
        catalog.dims_or_empty(spark, bug)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        catalog.dims_or_empty(spark, lambda: {"employees": spark.range(1).select(F.col("none"))})


def test_small_helpers(spark):
    row = spark.range(1).select(
        pages.as_base64(F.lit("abc").cast("binary")).alias("b"), pages.engine_message(F.lit(404), F.lit("m")).alias("a"),
        pages.engine_message(F.lit(500), F.lit("m")).alias("s"), pages.engine_message(F.lit(None).cast("int"), F.lit("m")).alias("n"),
    ).first()
    assert (row["b"], row["a"], row["s"], row["n"]) == ("YWJj", "model not available: m", "engine answered with status 500", "engine can't be reached")
    assert pages.fitted_size(3200, 1600) == (1600, 800) and pages.fitted_size(10, 20) == (10, 20)
