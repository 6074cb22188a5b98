"""Token ids of a corpus in binary shards, with keyed access through minimal perfect hashes.

File format: a Parquet folder, one row per block of at most BLOCK_DOCS documents (or BLOCK_IDS ids), in ascending doc_id order:

    shard int, block int       shards follow the ids' order, blocks the order in their shard
    shard_start bigint         ids before this block in its shard
    n_docs, n_null int         documents, and how many of them (the first) have a null doc_id
    n_tokens bigint            ids in payload
    first_id, last_id bigint   least and greatest non-null doc_id
    payload binary             all ids, little-endian unsigned 32-bit integers
    keys binary                the doc_id of each document with one, 64-bit integers, ascending
    displace, prints binary    minimal perfect hash of the distinct keys: displacements and stored fingerprints
    begin, count binary        by slot: offset of the key's first id in payload (64-bit), its documents (32-bit)
    place binary               by slot: number of the key's first document in the block (32-bit)
    ends binary                by document: offset after its last id in payload (64-bit)

A key is found in its block in constant time: hash, displacement, slot, fingerprint, offset.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from . import common
from .bpe import UnitMemo, broadcast_file
from .mph import MinimalPerfectHash

BLOCK_DOCS, BLOCK_IDS = 2048, 4 << 20
#: Shards at most; a bound for what the driver holds of the ids' order.
MAX_SHARDS = 4096
#: Bounds of shards that a document is held against at once.
FANOUT = 64
#: A letter, the ASCII signs after it up to a space, and the space; not ' (contractions), nor < | > (special tokens).
WORD_END = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:;=?@\[-`{}~]+) "
SCHEMA = (
    "shard int, block int, shard_start bigint, n_docs int, n_null int, n_tokens bigint, first_id bigint, last_id bigint, "
    "payload binary, keys binary, displace binary, prints binary, begin binary, count binary, place binary, ends binary"
)


class WordEncoder:
    """Encodes with a tokenizer of the tokenizers library whose pre-tokens never hold white space, are runs of letters among
    others, and end with an end-of-word token: a text is the sum of the pieces between spaces and line feeds. The distinct
    pieces of a batch are found in Arrow, the signs at the end of a word being a piece of their own (but for those that make
    contractions or special tokens), and each that is new is encoded once; new words go to the tokenizer as one text and are
    told apart by the ends of words. Words of a-z need no normalisation and no other split than at spaces, so a tokenizer of
    the same model without the rest takes them."""

    def __init__(self, tokenizer_json: bytes, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        short = Tokenizer.from_str(tokenizer_json.decode())
        short.normalizer = None
        short.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.short = short
        vocabulary = self.tokenizer.get_vocab()
        end = json.loads(tokenizer_json)["model"].get("end_of_word_suffix") or "</w>"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
        # lower case may come first for ASCII if the tokenizer tells no cases apart
        self.folds = self._whole(["AbC"]) == self._whole(["abc"]) == [short.encode("abc", add_special_tokens=False).ids]
        self.memo = UnitMemo(self._encode, limit)

    def _whole(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]

    def _words(self, words: list[str], tokenizer: Tokenizer) -> tuple | None:
        """All ids of words, from one call, and how many each has; None if the ends of words don't tell them apart."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.array(tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return None
        return ids, np.diff(stops, prepend=0)

    def _apart(self, units: list[str]) -> tuple:
        got = self._whole(units)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _encode(self, units: list[str]) -> tuple:
        """Ids of new units: words of a-z, other words, and the rest, each kind in one go, then put in their order."""
        kind = np.fromiter((0 if u.isascii() and u.islower() and u.isalpha() and self.folds else 1 if u.isalpha() else 2 for u in units), np.int8, len(units))
        sizes, parts = np.zeros(len(units), np.int64), []
        for k, tokenizer in ((0, self.short), (1, self.tokenizer), (2, None)):
            own = [units[i] for i in np.flatnonzero(kind == k)]
            got = (self._words(own, tokenizer) if tokenizer else None) or self._apart(own)
            sizes[kind == k] = got[1]
            parts.append(got)
        begin = np.zeros(len(units), np.int64)
        base = 0
        for k, (ids, own) in enumerate(parts):
            begin[kind == k] = base + np.cumsum(own) - own
            base += len(ids)
        flat = np.concatenate([p[0] for p in parts])
        stop = np.cumsum(sizes)
        total = int(stop[-1]) if len(stop) else 0
        return flat[np.repeat(begin - (stop - sizes), sizes) + np.arange(total)], sizes, False

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (nulls empty) in one array, and the n + 1 places where texts begin in it."""
        texts = pc.take(texts.cast(pa.large_string()), pa.array(np.arange(len(texts)))).fill_null("")  # a slice must not reach the splits
        if self.folds and not pc.any(pc.match_substring(texts, "<|")).as_py():  # where case could make a special token
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), WORD_END, "\\1 \\2 ")
        pieces = pc.split_pattern(texts, " ")
        distinct = pieces.flatten().dictionary_encode()
        numbers = self.memo.numbers(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())  # to_pylist makes a scalar of each
        ids, size = self.memo.expand(numbers[distinct.indices.to_numpy(zero_copy_only=False)])
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        return ids, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]


@functools.lru_cache(maxsize=2)
def worker_encoder(tokenizer_json: bytes) -> WordEncoder:
    return WordEncoder(tokenizer_json)


def _bounds(docs: DataFrame) -> list[int]:
    """Ids that part the documents into shards of alike size: from an aggregate of the doc_id column alone."""
    n = docs.count()
    shards = min(MAX_SHARDS, max(1, -(-n // BLOCK_DOCS)))
    if shards == 1:
        return []
    cuts = [k / shards for k in range(1, shards)]
    return sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, 20 * shards)).first()[0] or []))


def _pack(shard: int, block: int, start: int, ids: np.ndarray, sizes: np.ndarray, doc_ids: list) -> dict:
    """One row of the file; doc_ids ascend, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    keys = np.array(doc_ids[nulls:], np.int64)
    ends = np.cumsum(sizes).astype(np.int64)
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    perfect = MinimalPerfectHash.build(distinct.view(np.uint64))
    at = perfect.slots(distinct.view(np.uint64))
    begin, counts, place = np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i4"), np.zeros(len(distinct), "<i4")
    if len(distinct):
        begin[at] = (ends - sizes)[nulls:][first]
        counts[at] = count
        place[at] = nulls + first
    return {
        "shard": shard, "block": block, "shard_start": start, "n_docs": len(doc_ids), "n_null": nulls, "n_tokens": int(ids.size),
        "first_id": int(keys[0]) if len(keys) else None, "last_id": int(keys[-1]) if len(keys) else None,
        "payload": ids.astype("<u4").tobytes(), "keys": keys.astype("<i8").tobytes(),
        "displace": perfect.displace.astype("<i4").tobytes(), "prints": perfect.fingerprints.astype("<u4").tobytes(),
        "begin": begin.tobytes(), "count": counts.tobytes(), "place": place.tobytes(), "ends": ends.astype("<i8").tobytes(),
    }


_ARROW = pa.schema(
    [(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))]
)


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """Writes the token file of docs (doc_id, text) at path, a folder that all executors share, and returns its blocks.

    Every whole text is encoded without special tokens, and end_id is appended to each document. A null text is empty. A
    null doc_id sorts first and has no key; documents of one id lie together, ordered by text, and share a key. An empty
    table gives an empty file.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    file = broadcast_file(spark, tokenizer_path)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    bounds = _bounds(docs)
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))
    shard_of = _shard_column(bounds)
    parts = max(len(bounds) + 1, 1)

    def run(batches):
        encoder = worker_encoder(file.value)
        shard = block = start = None
        ids, sizes, keys, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([_pack(shard, block, start, np.concatenate(ids), np.concatenate(sizes), keys)], _ARROW)

        for piece in common.slices(batches, common.ARROW_ROWS):
            own = piece.column(0).to_pylist()
            flat, ends = encoder.encode_column(piece.column(1))
            of = np.array([0 if d is None else int(np.searchsorted(shared.value, d, "left")) for d in own])
            for a, b in _runs(of, BLOCK_DOCS // 8):
                if shard is not None and (of[a] != shard or len(keys) >= BLOCK_DOCS or held >= BLOCK_IDS):
                    yield row()
                    start, block = (start + held, block + 1) if of[a] == shard else (0, 0)
                    ids, sizes, keys, held = [], [], [], 0
                elif shard is None:
                    start = block = 0
                shard = int(of[a])
                part, size = flat[ends[a] : ends[b]], np.diff(ends[a : b + 1])
                if end_id is not None:
                    part = np.insert(part, np.cumsum(size), end_id)
                    size = size + 1
                ids.append(part)
                sizes.append(size)
                keys += own[a:b]
                held += len(part)
        if shard is not None:
            yield row()

    (
        docs.withColumn("__shard", shard_of)
        .repartitionById(parts, "__shard")
        .sortWithinPartitions("__shard", "doc_id", "text")
        .select("doc_id", "text")
        .mapInArrow(run, SCHEMA)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )
    return spark.read.parquet(path)


def _shard_column(bounds: list[int]):
    """How many bounds lie under doc_id, in two steps: of every FANOUT-th bound, then of those between two of them."""
    if not bounds:
        return F.lit(0)
    array = lambda own: f"array({','.join(f'{b}L' for b in own)})"
    groups = [bounds[k : k + FANOUT] for k in range(0, len(bounds), FANOUT)]
    heads = array(g[-1] for g in groups)
    group = f"size(filter({heads}, b -> b < doc_id))"
    inside = f"size(filter(element_at(array({','.join(map(array, groups))}), {group} + 1), b -> b < doc_id))"
    count = f"if({bounds[-1]}L < doc_id, {len(bounds)}, {FANOUT} * {group} + {inside})"
    return F.expr(f"if(doc_id is null, 0, {count})")


def _runs(of: np.ndarray, most: int):
    """Ranges of equal shard, at most `most` rows each."""
    at = 0
    while at < len(of):
        same = np.flatnonzero(of[at:] != of[at])
        end = min(at + (int(same[0]) if len(same) else len(of) - at), at + most)
        yield at, end
        at = end


class Block:
    """Keyed access to one row of the file."""

    def __init__(self, row: dict):
        self.payload = row["payload"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.n_docs, self.n_null, self.start = row["n_docs"], row["n_null"], row["shard_start"]
        self.begin, self.count = np.frombuffer(row["begin"], "<i8"), np.frombuffer(row["count"], "<i4")
        self.place = np.frombuffer(row["place"], "<i4")
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.perfect = MinimalPerfectHash(len(self.begin), np.frombuffer(row["displace"], "<i4"), np.frombuffer(row["prints"], "<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return self.perfect.find(np.asarray(keys, np.int64).view(np.uint64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key the offset of its first id in the payload and its number of documents (-1 and 0 if unknown)."""
        slot = self.slots(keys)
        if not len(self.begin):
            return slot, np.zeros(len(slot), np.int64)
        return np.where(slot < 0, -1, self.begin[slot]), np.where(slot < 0, 0, self.count[slot])

    def documents(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this doc_id, by offsets in the key's slot: constant time, whatever the block's size."""
        slot = int(self.slots(np.array([key]))[0])
        if slot < 0:
            return []
        first = int(self.place[slot])
        edges = [int(self.begin[slot]), *self.ends[first : first + int(self.count[slot])].tolist()]
        return [np.frombuffer(self.payload, "<u4", b - a, 4 * a) for a, b in zip(edges[:-1], edges[1:])]


def lookup(blocks: DataFrame, key: int) -> list[np.ndarray]:
    """The ids of the documents of one doc_id: only blocks whose range holds it are read, and none is scanned."""
    found = blocks.where((F.col("first_id") <= key) & (F.col("last_id") >= key)).orderBy("shard", "block")
    return [ids for r in found.toLocalIterator() for ids in Block(r.asDict()).documents(key)]


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of a token file, each
    taken from its block by key. Of the shards' sizes, at most MAX_SHARDS numbers are broadcast."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        .select(F.col("shard").alias("__s"), F.coalesce(F.sum("n").over(order), F.lit(0)).cast("bigint").alias("base"))
    )

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block, base = Block(row), row["base"]
                starts = block.ends - np.diff(block.ends, prepend=0)
                begin, count = block.find(block.keys)
                if len(block.keys) and ((begin < 0).any() or int(count.min()) < 1):
                    raise ValueError("a key of the block is not in its index")
                repeat = np.arange(len(block.keys)) - np.searchsorted(block.keys, block.keys, "left")
                begin = np.where(repeat == 0, begin, starts[block.n_null :])
                begin = np.concatenate([starts[: block.n_null], begin]).astype(np.int64)
                size = block.ends - begin
                raw = memoryview(block.payload)
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), size.tolist())]
                ids = pa.array([None] * block.n_null + block.keys.tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(begin + (base + block.start), pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    columns = ["payload", "keys", "n_docs", "n_null", "shard_start", "begin", "count", "place", "ends", "displace", "prints", "base"]
    return (
        blocks.join(F.broadcast(base), F.col("shard") == F.col("__s"))
        .select(*columns)
        .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def token_file_rows(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes a token file of docs into the shared folder and reads it back."""
    return read_documents(write_token_file(docs, common.fresh_path(spark, "tokens"), tokenizer_path, end_id))
