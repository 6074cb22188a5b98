"""SimHash near-duplicates by a generalised pigeonhole index.

A fingerprint has 64 bits: bit b is 1 if it is set in over half the XXH64 values (seed 42) of the text's four-word shingles.
Fingerprints that differ in at most RADIUS bits are linked, and links are closed to components.

The 64 bits are dealt to m parts, bits that correlate in a sample into the same part. Part i gets a threshold T_i >= -1 with
sum(T_i + 1) = RADIUS + 1: two fingerprints within RADIUS bits then differ in at most T_i bits of some part i. A dynamic
programme picks the thresholds, and the best m, by the probes and candidates that the sample lets expect. Every pair found
that way is verified on all bits; no cap is set on any bucket.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints that the plan is learned from at most; the index holds all.
SAMPLE = 4096
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Pairs compared at once; entries that one task compares with one another.
PAIRS, HEAVY = 1 << 20, 1 << 14


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    stops = list(itertools.accumulate(map(len, words)))
    stops = [s + k for k, s in enumerate(stops)]
    starts = [0, *[s + 1 for s in stops[:-1]]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops[size - 1 :])]


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    hashes = [shingle_hashes(t) for t in texts]
    size = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    has = np.flatnonzero(size)
    if len(has):
        flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(size.sum()))
        starts = np.concatenate([[0], np.cumsum(size[has])[:-1]])
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_ = (2 * count > size[has][:, None]).astype(np.uint8)
        out[has] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit integer) of every row."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for piece in common.slices(batches, 64):
            fp = fingerprints_of(common.texts_of(piece.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


class Plan:
    """Parts of the bits and their thresholds."""

    def __init__(self, parts: list[list[int]], thresholds: list[int]):
        self.parts, self.thresholds = parts, thresholds

    @classmethod
    def learn(cls, sample: np.ndarray, n: int, radius: int = RADIUS) -> Plan:
        """For n fingerprints of which sample are some. The cost of a part at a threshold is its probes and the rows that
        they can be expected to meet."""
        bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
        spread = bits.std(axis=0)
        near = np.abs(np.nan_to_num(np.cov(bits.T) / np.maximum(np.outer(spread, spread), 1e-9))) if len(sample) > 1 else np.zeros((64, 64))
        rng = np.random.default_rng(7)
        k = len(sample)
        left, right = (rng.integers(0, max(k, 1), 200_000) for _ in range(2))
        apart = sample[left] ^ sample[right] if k > 1 else np.zeros(0, np.uint64)
        apart = apart[apart != 0]
        best = None
        for m in range(2, radius + 2):
            parts = cls._group(near, m)
            costs = [[cls._cost(p, t, n, apart) for t in range(-1, radius + 1)] for p in parts]
            # reach[s]: least cost of the parts so far whose T_i + 1 add up to s
            reach = {0: (0.0, [])}
            for own in costs:
                step: dict = {}
                for s, (c, ts) in reach.items():
                    for t, x in enumerate(own):
                        if s + t <= radius + 1 and (s + t not in step or c + x < step[s + t][0]):
                            step[s + t] = (c + x, [*ts, t - 1])
                reach = step
            if radius + 1 in reach and (best is None or reach[radius + 1][0] < best[0]):
                best = (*reach[radius + 1], parts)
        return cls(best[2], best[1])

    @staticmethod
    def _group(near: np.ndarray, m: int) -> list[list[int]]:
        """m parts of alike size; each starts with the least free bit and takes the free bit nearest to its own."""
        free, parts = set(range(64)), []
        for i in range(m):
            own = [min(free)]
            free.discard(own[0])
            while len(own) < (64 + i) // m and free:
                nearest = max(sorted(free), key=lambda b: near[b, own].sum())
                own.append(nearest)
                free.discard(nearest)
            parts.append(sorted(own))
        parts[-1] = sorted(parts[-1] + list(free))
        return parts

    @staticmethod
    def _cost(part: list[int], t: int, n: int, apart: np.ndarray) -> float:
        if t < 0:
            return 0.0
        probes = sum(math.comb(len(part), k) for k in range(t + 1)) / (2 if t else 1)
        even = sum(math.comb(len(part), k) for k in range(t + 1)) / 2 ** len(part)
        mask = np.uint64(sum(1 << b for b in part))
        seen = float((np.bitwise_count(apart & mask) <= t).mean()) if len(apart) else 0.0
        return 20 * probes + n * max(even, seen) / 2

    def keys(self, fp: np.ndarray):
        """(row numbers, keys, probe?) of the index entries and probes of fingerprints, part by part. A probe goes to the
        greater of two values of a part only: one of each pair."""
        for i, (part, t) in enumerate(zip(self.parts, self.thresholds)):
            if t < 0:
                continue
            own = np.zeros(len(fp), np.uint64)
            for at, bit in enumerate(part):
                own |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
            tag = np.uint64(i)
            rows = np.arange(len(fp))
            yield rows, self._tagged(own, tag), False
            for k in range(1, t + 1):
                for flip in itertools.combinations(range(len(part)), k):
                    other = own ^ np.uint64(sum(1 << b for b in flip))
                    up = other > own
                    yield rows[up], self._tagged(other[up], tag), True

    @staticmethod
    def _tagged(own: np.ndarray, tag: np.uint64) -> np.ndarray:
        """Parts have at most 32 bits; the part's number goes above."""
        return ((tag << np.uint64(40)) | own).view(np.int64)


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component, for the graph of these edges between numbers."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int = RADIUS):
    """Verified links inside runs of equal keys, in bounded pieces, each as a forest: pairs of fingerprints. Rows of a run
    hold the index entries first. Entries meet entries, probes meet entries."""
    if len(key) < 2:
        return
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.repeat(start, np.diff(np.concatenate([start, [len(key)]])))
    entries = np.add.reduceat((~probe).astype(np.int64), start)
    many = np.minimum(np.arange(len(key)) - run, np.repeat(entries, np.diff(np.concatenate([start, [len(key)]]))))
    total = np.cumsum(many)
    at = 0
    while at < len(key):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        own = many[at:stop]
        row = np.repeat(np.arange(at, stop), own)
        other = np.repeat(run[at:stop], own) + (np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own))
        for k in range(0, len(row), 4 * PAIRS):
            r, o = row[k : k + 4 * PAIRS], other[k : k + 4 * PAIRS]
            good = (np.bitwise_count(fp[r] ^ fp[o]) <= radius) & (fp[r] != fp[o])
            if good.any():
                yield _forest(fp[r[good]].view(np.int64), fp[o[good]].view(np.int64))
        at = stop


def links(distinct: DataFrame, plan: Plan, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join the same components as all links do. In each bucket
    and piece of pairs only a forest of its links comes out, so no group of near copies is written out as all pairs. A bucket of
    more than `heavy` entries is compared by several tasks."""

    def probes(batches):
        for piece in common.slices(batches, 8192):
            fp = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for rows, keys, probe in plan.keys(fp):
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(fp[rows].view(np.int64)), pa.array(np.full(len(rows), probe))], ["k", "fp", "probe"]
                    )

    def verify(batches):
        held: list = []
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held.append((own[0], own[1].view(np.uint64), own[2].astype(bool)))
            key = own[0]
            if len(key) and key[0] == key[-1] and sum(len(h[0]) for h in held) < 1 << 21:
                continue  # one run so far
            joined = [np.concatenate(x) for x in zip(*held)]
            # the last run may go on in the next batch: its rows stay
            tail = int(np.searchsorted(joined[0], joined[0][-1], "left"))
            yield from out(joined[0][:tail], joined[1][:tail], joined[2][:tail])
            held = [tuple(x[tail:] for x in joined)]
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held)))

    def out(key, fp, probe):
        for a, b in bucket_links(key, fp, probe, radius):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    entries = common.cut(distinct.select("fp").mapInArrow(probes, "k bigint, fp bigint, probe boolean"))
    many = entries.where(~F.col("probe")).groupBy(F.col("k").alias("__k")).agg(F.ceil(F.count("*") / F.lit(heavy)).alias("parts")).where(F.col("parts") > 1)
    dealt = entries if many.isEmpty() else _in_cells(entries, many)
    return dealt.repartition("k").sortWithinPartitions("k", "probe").mapInArrow(verify, "a bigint, b bigint").distinct()


def _in_cells(entries: DataFrame, many: DataFrame) -> DataFrame:
    """entries with the buckets of `many` (__k, parts) taken apart: their entries fall into cells by a hash, each two cells, and
    each cell with itself, make a bucket of their own, and probes go to every cell. Any two entries, and each probe and entry,
    meet in some bucket; buckets that a hash of their name joins by chance cost comparisons only."""
    own = entries.join(many, F.col("k") == F.col("__k"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("int"))
    cell = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = lambda j: F.struct(F.when(F.col("probe"), j).otherwise(F.least(cell, j)).alias("i"), F.when(F.col("probe"), j).otherwise(F.greatest(cell, j)).alias("j"))
    spread = own.withColumn("to", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)))
    name = F.when(F.col("parts") == 1, F.col("k")).otherwise(F.xxhash64("k", "to.i", "to.j"))
    return spread.select(name.alias("k"), "fp", "probe")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id (the least doc_id that links lead to).

    Null and empty texts have fingerprint zero and are linked like others. Rows with a null doc_id get a fingerprint and
    their component's least doc_id (null if it has none); repeated rows give repeated results, and so do different texts of
    one doc_id, each by its own fingerprint. Texts of any length are taken whole; columns besides doc_id and text are not
    looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = common.cut(fingerprints(docs))
    # a fingerprint is known by its least doc_id, so the least of a component is its name and nothing need be gathered by it
    least = F.min("doc_id")
    name = F.struct(least.isNull().alias("none"), F.coalesce(least, F.col("fp")).alias("id"))
    distinct = common.cut(own.groupBy("fp").agg(name.alias("name")))
    n = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    plan = Plan.learn(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), n, radius) if n else Plan([], [])
    found = links(distinct, plan, radius)
    for side in ("a", "b"):
        names = distinct.select(F.col("fp").alias("__fp"), F.col("name").alias(f"__{side}"))
        found = found.join(names, F.col(side) == F.col("__fp")).drop("__fp")
    roots = components(found, "__a", "__b")
    classes = distinct.join(roots, F.col("name") == F.col("node"), "left").select(F.col("fp").alias("__f"), F.coalesce("root", "name").alias("__r"))
    joined = own.join(classes, F.col("fp") == F.col("__f"))
    component = F.when(~F.col("__r.none"), F.col("__r.id")).alias("component_id")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when of each component only the document of least doc_id is kept, with their columns.

    Rows without a doc_id stay. Of several rows of that doc_id one stays: the first by text (null first), then by a hash of
    its other columns.
    """
    classes = near_duplicates(docs.where(F.col("doc_id").isNotNull()))
    keep = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__keep")).distinct()
    stays = docs.join(keep, F.col("doc_id") == F.col("__keep"), "left_semi")
    rest = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    first = Window.partitionBy("doc_id").orderBy("text", rest)
    stays = stays.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")
    return stays.unionByName(docs.where(F.col("doc_id").isNull()))
