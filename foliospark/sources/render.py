"""Documents to pages: a renderer for each kind of file, chosen by its extension; pictures are pages as they are.

Renderers are registered by the caller, since no library that draws PDF pages is part of this package. A file without one, a
picture too large to open, or a renderer that fails gives one row with an error; other documents go on.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffix
from .pages import BOMB_PIXELS, MAX_PAGES

#: A renderer gives the pages of a file's bytes, one after another, as pictures.
Renderer = Callable[[bytes], Iterable[bytes]]
PICTURES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
PAGES = "doc_id string, page_no int, content binary, error string"
_RENDERERS: dict[str, Callable[[], Renderer]] = {}


def register_renderer(extension: str, make: Callable[[], Renderer]) -> None:
    """make() runs once in each task and may load a library."""
    _RENDERERS[extension] = make


def picture_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, BMP or JPEG file; null for others."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"BM" and len(content) >= 26:
        width, height = struct.unpack("<ii", content[18:26])
        return abs(width), abs(height)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # the frame's head
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def _picture() -> Renderer:
    def run(content: bytes) -> Iterable[bytes]:
        size = picture_size(content)
        if size and size[0] * size[1] > BOMB_PIXELS:
            raise ValueError(f"a picture of {size[0]} x {size[1]} pixels is not opened")
        return [content]

    return run


def _unread_pdf() -> Renderer:
    def run(content: bytes) -> Iterable[bytes]:
        if content[:5] == b"%PDF-":
            raise ValueError("no renderer is registered for .pdf")
        return [content]  # recognised text in a PDF's place

    return run


for _extension in PICTURES:
    register_renderer(_extension, _picture)
register_renderer(".pdf", _unread_pdf)


def render(documents: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """doc_id, page_no (from 1), content, error: the first pages of each document (doc_id, name, content), and one page more
    where there is one, so that the cap can be seen."""
    made = dict(_RENDERERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, Renderer] = {}
        for rows in batches:
            for doc, kind, content in zip(rows["doc_id"], rows["kind"], rows["content"]):
                try:
                    if kind not in made:
                        raise ValueError(f"no renderer is registered for {kind or 'files without an extension'}")
                    if kind not in own:
                        own[kind] = made[kind]()
                    found = list(itertools.islice(own[kind](bytes(content)), most + 1))
                    yield pd.DataFrame({"doc_id": doc, "page_no": range(1, len(found) + 1), "content": found, "error": None})
                except Exception as problem:  # noqa: BLE001  one bad document must not end the run
                    yield pd.DataFrame({"doc_id": [doc], "page_no": [1], "content": [None], "error": [str(problem)[:200]]})

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), suffix(F.col("name")).alias("kind"), "content").mapInPandas(run, PAGES)
