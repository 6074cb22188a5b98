"""Nearest neighbours by multi-index hashing.

Rotations learned from a sample by iterative quantisation turn a vector into a binary code of several times 64 bits. Codes
are cut into m substrings, and each block of rows has an index of every substring: a table of 2 ** SUBSTRING places from its
value to the rows that have it. A query looks up, in each table, every value that differs from its own in at most REACH bits.
By the pigeonhole principle that finds every code within m * (REACH + 1) - 1 bits of the query's, and of those further away
the ones that are near in some substring; how many of the true neighbours that leaves out is measured against brute force. Rows
found are verified on all bits against a radius calibrated on the sample, and those left are ranked by their float vectors.

Queries go out in blocks of bounded size against all rows; a task keeps the best few rows of each query and sends only those.
"""

from __future__ import annotations

import dataclasses
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that rotations and radius are learned from at most.
SAMPLE = 4096
#: Rotations, bits of a substring, bits in which a probe may differ, queries of a block, rows of an index.
ROTATIONS, SUBSTRING, REACH, QUERIES, ROWS = 15, 18, 3, 4096, 1 << 16
#: Share of the sample's true neighbours that the radius must hold.
HELD = 0.985
SCHEMA = "query_id bigint, vec_id bigint, score double"
#: What a value is changed by to give all values within REACH bits.
PROBES = np.array([sum(1 << b for b in bits) for k in range(REACH + 1) for bits in itertools.combinations(range(SUBSTRING), k)], np.int32)


def unit_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, norms) of the rows that take part: an id, dim finite components, not all zero. Vectors whose squares a
    double can't hold are scaled, which leaves their cosines as they are."""
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(length) - length
    good = np.flatnonzero((length == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
    if not len(good):
        return np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    x = flat[begin[good][:, None] + np.arange(dim)]
    own = ids.take(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x, own = x[fine], own[fine]
    with np.errstate(over="ignore", under="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        odd = ~np.isfinite(norm) | (norm < 1e-150)
        if odd.any():
            x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
            norm[odd] = np.sqrt((x[odd] * x[odd]).sum(axis=1))
    return own, x, norm


@dataclasses.dataclass
class Codes:
    """The learned quantiser."""

    mean: np.ndarray
    rotations: np.ndarray  # dim x bits
    radius: int

    @classmethod
    def learn(cls, unit: np.ndarray, k: int, rotations: int = ROTATIONS) -> Codes:
        dim = unit.shape[1]
        mean = unit.mean(axis=0)
        x = unit - mean
        # principal directions first, at most 64 of them, at least 18 bits a rotation
        _, _, axes = np.linalg.svd(x if len(x) > 1 else np.eye(dim), full_matrices=True)
        width = 64 if dim >= 64 else max(dim, SUBSTRING)
        axes = axes[: min(dim, width)].T
        y = x @ axes
        out = []
        for r in range(rotations):
            rng = np.random.default_rng(100 + r)
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0][: y.shape[1]]
            for _ in range(12 if len(x) > width else 0):
                signs = np.sign(y @ turn)
                u, _, v = np.linalg.svd(y.T @ signs, full_matrices=False)
                turn = u @ v
            out.append(axes @ turn)
        all_bits = np.concatenate(out, axis=1)
        own = cls(mean, all_bits[:, : all_bits.shape[1] // SUBSTRING * SUBSTRING], 0)
        own.radius = own._radius(unit, k)
        return own

    def _radius(self, unit: np.ndarray, k: int) -> int:
        """The radius within which nearly all of the k best of the sample lie."""
        codes = self.encode(unit)
        far = []
        for i in np.arange(0, len(unit), max(1, len(unit) // 512)):
            near = unit @ unit[i]
            near[i] = -2
            best = np.argsort(-near, kind="stable")[: min(k, len(unit) - 1)]
            far += np.bitwise_count(codes[best] ^ codes[i]).sum(axis=1).tolist()
        return int(np.quantile(far, HELD)) if far else self.rotations.shape[1]

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings of SUBSTRING bits."""
        bits = (unit - self.mean) @ self.rotations > 0
        return bits.reshape(len(unit), -1, SUBSTRING) @ (1 << np.arange(SUBSTRING, dtype=np.int32))


class MultiIndex:
    """Substring indexes over one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for own in codes.T:
            order = np.argsort(own, kind="stable").astype(np.int32)
            start = np.zeros((1 << SUBSTRING) + 1, np.int32)
            np.cumsum(np.bincount(own, minlength=1 << SUBSTRING), out=start[1:])
            self.tables.append((order, start))

    def probed(self, code: np.ndarray) -> np.ndarray:
        """The rows that some table has under a value within REACH bits of the code's own, ascending."""
        found = np.zeros(len(self.codes), bool)
        for value, (order, start) in zip(code, self.tables):
            probes = PROBES ^ value
            first, size = start[probes], start[probes + 1] - start[probes]
            some = size > 0
            first, size = first[some], size[some]
            stop = np.cumsum(size)
            if len(stop):
                found[order[np.repeat(first - (stop - size), size) + np.arange(stop[-1])]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows probed whose code differs in at most radius bits."""
        rows = self.probed(code)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int32) <= radius]

    def search(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows within the radius, or where fewer than `least` are found the least distant of all rows: a query that the index
        serves badly is served by a scan of the block's codes, and no query goes without neighbours."""
        rows = self.within(code, radius)
        least = min(least, len(self.codes))
        if len(rows) >= least:
            return rows
        far = np.bitwise_count(self.codes ^ code).sum(axis=1, dtype=np.int32)
        edge = np.partition(far, least - 1)[least - 1]
        return np.union1d(rows, np.flatnonzero(far <= edge))


class _Best:
    """The k best rows of each query so far: largest score, then least id."""

    def __init__(self, n: int, k: int):
        self.score, self.ids, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.ids[q], ids]), np.concatenate([self.score[q], score])
        best = np.lexsort((ids, -score))[: self.k]
        self.ids[q], self.score[q] = ids[best], score[best]


def dimension(embeddings: DataFrame) -> int | None:
    """The most common length of the vectors."""
    row = embeddings.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else None


def search(embeddings: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query row its k nearest other rows: query_id, rank (from 1), vec_id, score (the cosine in double precision).

    Nearest first, ties to the smaller vec_id. Null, zero, null-holding or non-finite vectors, those of another length than
    most, and rows without an id take no part. Rows with a query's own id are not its candidates. Copies of a vector are
    ranked one by one; fewer than k candidates give fewer rows; an empty table gives none. Other columns are not looked at.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    dim = dimension(rows)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if dim is None:
        return empty
    picked = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    _, x, norm = unit_rows(*_columns(picked), dim)
    if not len(x):
        return empty
    shared = spark.sparkContext.broadcast(Codes.learn(x / norm[:, None], k))
    queries = rows.where(is_query(F.col("vec_id")) & (F.size("embedding") == dim))
    blocks, path, some = -(-queries.count() // QUERIES), common.fresh_path(spark, "neighbours"), False
    for b in range(blocks):  # one block's queries are held and sent at a time; its results are written
        some |= _block(rows, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), shared, dim, k, f"{path}/block={b}")
    if not some:
        return empty
    found = spark.read.schema(SCHEMA).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _columns(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """The two columns of a table as single arrays."""
    return tuple(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns)


def _block(rows: DataFrame, queries: DataFrame, shared, dim: int, k: int, path: str) -> bool:
    """Writes the best rows of these queries, found by each task among its own rows; False if none of them takes part."""
    ids, x, norm = unit_rows(*_columns(queries.toArrow()), dim)
    if not len(ids):
        return False
    order = np.argsort(ids, kind="stable")
    sent = rows.sparkSession.sparkContext.broadcast((ids[order], x[order], norm[order]))

    def run(batches):
        codes = shared.value
        q_ids, q, q_norm = sent.value
        q_codes = codes.encode(q / q_norm[:, None])
        best = _Best(len(q_ids), k)
        held: list = []

        def match():
            i, v, n = (np.concatenate(z) for z in zip(*held))
            index = MultiIndex(codes.encode(v / n[:, None]))
            for a in range(len(q_ids)):
                near = index.search(q_codes[a], codes.radius, k + 1)
                near = near[i[near] != q_ids[a]]
                if len(near):
                    score = (v[near] * q[a]).sum(axis=1) / (n[near] * q_norm[a])
                    if len(near) > k:
                        floor = -np.partition(-score, k - 1)[k - 1]
                        near, score = near[score >= floor], score[score >= floor]
                    best.offer(a, i[near], score)

        for piece in common.slices(batches, ROWS):
            part = unit_rows(piece.column(0), piece.column(1), dim)
            if len(part[0]):
                held.append(part)
            if sum(len(h[0]) for h in held) >= ROWS:
                match()
                held = []
        if held:
            match()
        good = np.isfinite(best.score)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_ids, good.sum(axis=1))), pa.array(best.ids[good]), pa.array(best.score[good])], ["query_id", "vec_id", "score"]
        )

    rows.mapInArrow(run, SCHEMA).write.parquet(path)
    sent.destroy()
    return True


def exact(embeddings: dict, queries: list, k: int = 5) -> list[tuple]:
    """Brute force over {vec_id: vector}, for tests and recall: (query_id, rank, vec_id)."""
    ids = np.array(sorted(embeddings))
    x = np.array([embeddings[i] for i in ids], np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    out = []
    for q in queries:
        at = int(np.searchsorted(ids, q))
        score = (x * x[at]).sum(axis=1) / (n * n[at])
        score[at] = -np.inf
        best = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        out += [(q, r + 1, int(ids[b])) for r, b in enumerate(best)]
    return out
