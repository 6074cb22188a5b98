"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark's words, run over each text once.

A benchmark too large for one automaton in a worker's memory is dealt to several by a hash of the item; texts then pass them
one after another, and hits add up by position, so the result is the one that a single automaton would give.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Words of a window.
WINDOW = 13
#: UTF-8 bytes of benchmark text for one automaton, built in every worker: its windows hold each word WINDOW times, and a node
#: for each byte of them takes some 40 bytes of memory.
MAX_BYTES = 1 << 20
#: Bytes that part words become spaces, A-Z become a-z; digits, a-z and all bytes of non-ASCII characters stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def fold(raw: bytes) -> bytes:
    """The text's bytes, one for one, with only word bytes and spaces left: an offset in it is one in the original."""
    return raw.translate(_FOLD)


def words_of(text: str | None) -> list[bytes]:
    return fold((text or "").encode("utf-8", "surrogatepass")).split()


class Matcher:
    """The automaton. Patterns are windows written as ' w1 w2 ... w13 ' over one string per text, scanned once."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        patterns: dict[str, tuple[int, set]] = {}
        for item, words in items:
            n = min(window, len(words))
            for k in range(len(words) - n + 1 if n else 0):
                joined = " " + b" ".join(words[k : k + n]).decode("utf-8", "surrogatepass") + " "
                patterns.setdefault(joined, (n, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for joined, found in patterns.items():
            self.automaton.add_word(joined, found)
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        hit, items = np.zeros(len(words), bool), set()
        if self.empty or not words:
            return hit, items
        joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        ends = None
        for at, (n, own) in self.automaton.iter(joined):
            if ends is None:  # the place of the space after each word
                ends = np.cumsum([len(w.decode("utf-8", "surrogatepass")) + 1 for w in words])
            last = int(np.searchsorted(ends, at))
            hit[last + 1 - n : last + 1] = True
            items |= own
        return hit, items


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as spans of code points in the original text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(fold(raw), np.uint8) != 0x20
    edge = np.diff(folded.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    run = np.diff(hit.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    return [(int(point[begin[a]]), int(point[end[b]])) for a, b in zip(first, last)]


@functools.lru_cache(maxsize=2)
def _matcher(key: str, window: int, items: tuple) -> Matcher:
    return Matcher([(i, w.split()) for i, w in items], window)


def benchmark_groups(benchmark: DataFrame, max_bytes: int = MAX_BYTES):
    """The benchmark in groups of about max_bytes at most, one at a time: (item_id as text, its words joined) of each row with
    words. The number of groups comes from the size of all texts, read before any is gathered."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.length("text") > 0)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // max_bytes))
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else rows
        items = {((r["item_id"] or ""), b" ".join(words_of(r["text"]))) for r in own.collect()}
        yield tuple(sorted(x for x in items if x[1])), g == groups - 1


SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "spans array<struct<start:bigint,end:bigint>>"
)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
#: Between automata: which words were hit, as bits, and the items that occurred.
SO_FAR = "__bits binary, __found array<string>"


def _pass(docs: DataFrame, kept: list, items: tuple, window: int, last: bool, at: int) -> DataFrame:
    """docs after one more automaton: the columns named and, after the last one, results, else what was found so far."""
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(items).encode()).hexdigest(), window, items))
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:6] + ["spans"]
    earlier = "__bits" in docs.columns
    result = StructType([docs.schema[c] for c in kept])
    for f in (StructType.fromDDL(SCHEMA).fields[1:] if last else StructType.fromDDL(SO_FAR).fields):
        result.add(f"__hit_{f.name}" if last else f.name, f.dataType)

    def run(batches):
        matcher = _matcher(*shared.value)
        for piece in common.slices(batches):
            out, bits, found = {n: [] for n in names}, [], []
            before = zip(piece.column(len(kept)).to_pylist(), piece.column(len(kept) + 1).to_pylist()) if earlier else itertools.repeat((b"", []))
            for text, (old_bits, old_items) in zip(common.texts_of(piece.column(at)), before):
                words = words_of(text)
                hit, own = matcher.scan(words)
                own = own | set(old_items)
                if old_bits:
                    hit |= np.unpackbits(np.frombuffer(old_bits, np.uint8), count=len(words)).astype(bool)
                if not last:
                    bits.append(np.packbits(hit).tobytes())
                    found.append(sorted(own))
                    continue
                n = int(hit.sum())
                out["n_words"].append(len(words))
                out["n_hit"].append(n)
                out["n_items"].append(len(own))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(own)).encode()).hexdigest())
                out["contaminated"].append(n > 0 and 20 * n >= len(words))
                out["spans"].append([{"start": a, "end": b} for a, b in hit_spans(text, hit)] if n else [])
            own = [pa.array(out[n], t) for n, t in zip(names, _TYPES)] if last else [pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], *own], result.names)

    return docs.mapInArrow(run, result)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row of docs: its words, the words inside occurrences of benchmark windows, the items that occur, and spans of the
    hit words in the original text.

    Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased. An item of fewer words than the
    window, but not none, is one window. A null text has no words; a null item_id counts as the empty text, and items that
    share an id are one; an empty benchmark hits nothing, an empty table gives no rows, repeated rows give repeated results.
    Texts of any length are taken whole. With carry the columns of docs come back too, whatever their names, ours as __hit_*.
    """
    common.small_batches(docs.sparkSession)
    if not carry:
        docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    kept = docs.columns
    for items, last in benchmark_groups(benchmark, max_bytes):
        docs = _pass(docs, kept, items, window, last, kept.index("text"))
        if not last:
            docs = common.cut(docs)  # so that a worker holds one automaton at a time
    if carry:
        return docs
    return docs.select("doc_id", *[F.col(f"__hit_{c.split()[0]}").alias(c.split()[0]) for c in SCHEMA.split(", ")[1:6]], F.col("__hit_spans").alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    clean = contamination(docs, benchmark, carry=True).where(~F.col("__hit_contaminated"))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
