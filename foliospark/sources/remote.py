"""Models behind HTTP, for recognising pages and for reading records from text: a chat endpoint that takes a model's name,
messages and options as JSON and answers with a message (the public API of the Ollama server). Calls are made in tasks, one row
at a time; a call that fails gives its row an error, and other rows go on."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import Engine, register_engine

#: Seconds that a call may take: pictures are slow without a graphics card.
PICTURE_SECONDS, TEXT_SECONDS = 900.0, 300.0
READ_PAGE = "Transcribe todo el texto visible de esta imagen, línea por línea y en su orden, sin añadir ni resumir nada."
READ_RECORD = (
    "Lee el siguiente texto de un documento de ausentismo laboral y responde solo con un objeto JSON con las secciones paciente "
    "(nombre, documento_tipo, documento_numero), entidad (eps, ips_prestador), incapacidad (fecha_inicio, fecha_fin, dias, "
    "fecha_expedicion, tipo, origen), diagnostico (cie10, descripcion) y medico (nombre, registro). Fechas como AAAA-MM-DD, dias "
    "como número entero, null donde falte un dato.\n\n"
)


class Unanswered(Exception):
    """A call without a usable answer, with what to tell the user."""


def chat(url: str, model: str, prompt: str, pictures: tuple[bytes, ...] = (), as_json: bool = False, seconds: float = TEXT_SECONDS) -> str:
    """The answer to one message, at temperature 0."""
    message = {"role": "user", "content": prompt} | ({"images": [base64.b64encode(p).decode() for p in pictures]} if pictures else {})
    body = {"model": model, "messages": [message], "stream": False, "options": {"temperature": 0.0}} | ({"format": "json"} if as_json else {})
    request = urllib.request.Request(f"{url.rstrip('/')}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return str(json.load(answer)["message"]["content"])
    except urllib.error.HTTPError as problem:
        raise Unanswered(f"model not available: {model}" if problem.code == 404 else f"engine answered with status {problem.code}") from problem
    except (OSError, ValueError, KeyError, TypeError) as problem:
        raise Unanswered(f"engine can't be reached or understood: {problem}") from problem


def register_vision(url: str, model: str, name: str = "ollama", seconds: float = PICTURE_SECONDS) -> None:
    """An engine of this name that has the model transcribe each page."""

    def make() -> Engine:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                text = [chat(url, model, READ_PAGE, (bytes(c),), seconds=seconds) for c in rows["content"]]
                yield pd.DataFrame({"doc_id": rows["doc_id"], "page_no": rows["page_no"], "text": text, "error": None})

        return run

    register_engine(name, make)


def replies(texts: DataFrame, ask: Callable[[str], str], path: str = "path", text: str = "text") -> DataFrame:
    """texts with reply: what ask(text) says of each text, null where there is no text or no answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(value: str | None) -> str | None:
            try:
                return ask(value) if value else None
            except Unanswered:  # rules alone then read the document
                return None

        for rows in batches:
            yield pd.DataFrame({"__path": rows["path"], "reply": [one(v) for v in rows["text"]]})

    asked = texts.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInPandas(run, "__path string, reply string")
    return texts.join(asked, F.col(path) == F.col("__path"), "left").drop("__path")


def record_reader(url: str, model: str, seconds: float = TEXT_SECONDS) -> Callable[[str], str]:
    """ask for replies(): a record of a text as JSON."""
    return lambda value: chat(url, model, READ_RECORD + value, as_json=True, seconds=seconds)
