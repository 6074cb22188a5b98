"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary gives the id of a pre-token that is in it as a whole.
Tier two: other pre-tokens are merged by a heap of adjacent pairs over a doubly linked list of bytes, least rank first.

The vocabulary's ranks come from a file named by the caller; the driver reads it and broadcasts its bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from . import common
from .mph import MinimalPerfectHash


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 of the bytes, the rank) and a pattern of pre-tokens."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {}
        for line in ranks_file.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        keys = self._keys(tokens)
        self.perfect = MinimalPerfectHash.build(keys)
        at = self.perfect.slots(keys)
        self.slot_token: list = [b""] * len(tokens)
        self.slot_rank = np.zeros(len(tokens), np.int64)
        for s, t in zip(at.tolist(), tokens):
            self.slot_token[s] = t
            self.slot_rank[s] = self.ranks[t]
        self.token_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            self.token_of[r] = t
        self._size = np.array([len(t) for t in self.token_of], np.int64)
        self._blob = np.frombuffer(b"".join(self.token_of), np.uint8)
        self._at = np.concatenate([[0], np.cumsum(self._size)])

    @staticmethod
    def _keys(tokens: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)

    def whole(self, pieces: list[bytes]) -> list[int]:
        """Tier one: the id of each piece that is in the vocabulary as a whole, else -1."""
        if not pieces:
            return []
        at = self.perfect.find(self._keys(pieces)).tolist()
        return [int(self.slot_rank[s]) if s >= 0 and self.slot_token[s] == p else -1 for p, s in zip(pieces, at)]

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: merges the pair of least rank, the leftmost of equals, until none is in the vocabulary."""
        ranks, n = self.ranks, len(piece)
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if end[i] < 0 or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = left[i]
            if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = right[i]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        return [[i] if i >= 0 else self.merge(p) for p, i in zip(raw, self.whole(raw))]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """The ids of each text, its pre-tokens taken by the pattern."""
        found = [self.pattern.findall(u) for u in units]
        flat = self.encode_pieces([p for f in found for p in f])
        out, at = [], 0
        for f in found:
            out.append([i for ids in flat[at : at + len(f)] for i in ids])
            at += len(f)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after another."""
        if not len(ids):
            return b""
        size, begin = self._size[ids], self._at[ids]
        stop = np.cumsum(size)
        at = np.repeat(begin - (stop - size), size) + np.arange(stop[-1])
        return self._blob[at].tobytes()


class _Numbers(dict):
    """Gives each key not seen before the next number, and keeps a list of those keys."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        number = self[key] = len(self)
        return number


class UnitMemo:
    """Ids of units of text already encoded, in flat arrays, at most `limit` of them and what one call adds. encode gets the
    new units of a call at once and gives all their ids, how many each has, and which to flag (or False)."""

    def __init__(self, encode, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.known = _Numbers()
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.flagged = np.zeros(1 << 12, bool)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def numbers(self, units: list) -> np.ndarray:
        """A number for each unit, good for expand() until the next call."""
        if len(self.known) > self.limit:
            self._reset()
        known, first = self.known, len(self.known)
        out = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        if known.new:
            new, known.new = known.new, []
            flat, sizes, flagged = self.encode(new)
            while len(self.begin) < first + len(new):
                for name in ("begin", "size", "flagged"):
                    setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
            while len(self.ids) < self.used + len(flat):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.begin[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[first : first + len(new)] = sizes
            self.flagged[first : first + len(new)] = flagged
            self.used += len(flat)
        return out

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these units in order, and how many each unit has."""
        size = self.size[numbers].astype(np.int64)
        stop = np.cumsum(size)
        if not len(stop) or not stop[-1]:
            return np.zeros(0, np.uint32), size
        at = np.repeat(self.begin[numbers] - (stop - size), size)
        at += np.arange(stop[-1])
        return self.ids[at], size


class TextEncoder:
    """Encodes many texts at once. At a single space between two characters that aren't white space a pre-token always
    begins, and none reaches over it; so a text is the sum of its units (a space and what follows up to the next one),
    unless a unit is empty or has white space at an end. The first unit has no space; its key is a tuple."""

    def __init__(self, bpe: ByteBPE, limit: int = 600_000):
        self.bpe, self.memo = bpe, UnitMemo(self._units, limit)

    def _units(self, units: list) -> tuple:
        texts = [u[0] if type(u) is tuple else " " + u for u in units]
        own = [t if type(u) is tuple else u for t, u in zip(texts, units)]
        good = [bool(u) and not u[0].isspace() and not u[-1].isspace() for u in own]
        found = iter(self.bpe.encode_units([t for t, g in zip(texts, good) if g]))
        got = [next(found) if g else () for g in good]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum())), sizes, ~np.array(good, bool)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the n + 1 places where texts begin in it."""
        units: list = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                own = t.split(" ")
                own[0] = (own[0],)
                units += own
                counts[k] = len(own)
        numbers = self.memo.numbers(units)
        flags = self.memo.flagged[numbers]
        ids, size = self.memo.expand(numbers)
        at = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        if not flags.any():
            return ids, ends
        bad = {int(k) for k in np.searchsorted(at, np.flatnonzero(flags), "right") - 1}
        parts = [np.array(self.bpe.encode_units([texts[k]])[0], np.uint32) if k in bad else ids[ends[k] : ends[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@functools.lru_cache(maxsize=2)
def worker_encoder(ranks_file: bytes, pattern: str) -> TextEncoder:
    """One encoder for each Python worker, kept between tasks."""
    return TextEncoder(ByteBPE(ranks_file, pattern))


def broadcast_file(spark, path: str, limit: int = 64 << 20):
    """A vocabulary file's bytes, broadcast; files over the limit are refused."""
    with open(path, "rb") as f:
        raw = f.read(limit + 1)
    if len(raw) > limit:
        raise ValueError(f"{path} has more than {limit} bytes")
    return spark.sparkContext.broadcast(raw)


SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, digests_only: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, the ids as little-endian unsigned 32-bit integers, and digests.

    Every whole text is encoded and the ids decoded again. A null text counts as empty: 0 ids, digests of no bytes.
    Repeated rows give repeated results; other columns of docs are ignored. With digests_only the ids are left out.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    file = broadcast_file(spark, ranks_path)
    names = [c.split()[0] for c in SCHEMA.split(", ") if not (digests_only and c.startswith("ids "))]

    def run(batches):
        encoder = worker_encoder(file.value, pattern)
        for piece in common.slices(batches):
            texts = common.texts_of(piece.column(1))
            ids, ends = encoder.encode_batch(texts)
            ids = ids.astype("<u4", copy=False)
            raw = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            back = [encoder.bpe.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            out = {
                "doc_id": piece.column(0),
                "n_tokens": pa.array(np.diff(ends), pa.int64()),
                "ids": pa.array(raw, pa.binary()),
                "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
            }
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in names)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the text of each row's ids (binary, as encode_documents makes them); null ids give a null text."""
    file = broadcast_file(encoded.sparkSession, ranks_path)

    def run(batches):
        bpe = worker_encoder(file.value, pattern).bpe
        for piece in common.slices(batches):
            texts = [None if r is None else bpe.decode(np.frombuffer(r, "<u4")).decode("utf-8", "replace") for r in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every row; a null text has none."""
    spark = docs.sparkSession
    common.small_batches(spark)
    file = broadcast_file(spark, ranks_path)

    def run(batches):
        encoder = worker_encoder(file.value, pattern)
        for piece in common.slices(batches):
            _, ends = encoder.encode_batch(common.texts_of(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(ends), pa.int64())], ["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
