"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of 0 to ORDER bytes with counts of the byte that follows. A byte seen after its
context costs -log2(count / (total + distinct)); otherwise an escape costs -log2(distinct / (total + distinct)) and the
context loses its oldest byte; under the empty context an unseen byte costs an escape and 8 bits. Counts stay as learned,
so a text's code length in a language is an exact sum over its bytes. The language of least code length is predicted.

All trees share one numbering of contexts, so the lengths in all languages come from the same table lookups, for many
texts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the longest context (2 or 3).
ORDER = 3
#: Labelled documents that a language's statistics come from at most, and their bytes at most.
PER_LANGUAGE, MAX_BYTES = 400, 4 << 20
#: Languages at most; a bound for the model's size.
MAX_LANGUAGES = 64
_LETTER = regex.compile(r"\p{L}")


class PPM:
    """Context trees of several languages, learned from {language: texts}."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.languages = sorted(texts)
        self.order = order
        raw = [[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) for t in texts[x]] for x in self.languages]
        n = len(self.languages)
        # by order k: the sorted codes of all (k context bytes, byte), their lengths in bits; escape[k]: bits by context
        self.codes, self.bits, self.contexts, self.escape = [], [], [], []
        counted = []
        for k in range(order + 1):
            own = []
            for lang in raw:
                grams = np.concatenate([np.zeros(0, np.int64), *(self._grams(b, k) for b in lang)])
                own.append(np.unique(grams, return_counts=True))
            codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in own)]))
            counts = np.zeros((len(codes), n))
            for x, (c, m) in enumerate(own):
                counts[np.searchsorted(codes, c), x] = m
            counted.append((codes, counts))
        for k, (codes, counts) in enumerate(counted):
            contexts, owner = np.unique(codes >> 8, return_inverse=True)
            total = np.zeros((len(contexts), n))
            np.add.at(total, owner, counts)
            distinct = np.zeros((len(contexts), n))
            np.add.at(distinct, owner, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(counts / (total + distinct)[owner])
            lower = self._lower(codes, k)
            bits = np.where(counts > 0, seen, escape[owner] + lower)
            self.codes.append(codes)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escape.append(escape)

    @staticmethod
    def _grams(b: np.ndarray, k: int) -> np.ndarray:
        """The codes of all runs of k + 1 bytes."""
        if len(b) <= k:
            return np.zeros(0, np.int64)
        code = np.zeros(len(b) - k, np.int64)
        for j in range(k + 1):
            code = code << 8 | b[j : len(b) - k + j]
        return code

    def _lower(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Lengths of the last byte of each code under the next shorter context."""
        if k == 0:
            return np.full((len(codes), len(self.languages)), 8.0)
        return self.lengths(codes & ((1 << 8 * k) - 1), k - 1)

    def lengths(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Bits in each language of the last byte of each code after the k bytes before it."""
        out = np.empty((len(codes), len(self.languages)))
        at = np.minimum(np.searchsorted(self.codes[k], codes), max(len(self.codes[k]) - 1, 0))
        seen = self.codes[k][at] == codes if len(self.codes[k]) else np.zeros(len(codes), bool)
        out[seen] = self.bits[k][at[seen]]
        if not seen.all():
            rest = codes[~seen]
            where = np.minimum(np.searchsorted(self.contexts[k], rest >> 8), max(len(self.contexts[k]) - 1, 0))
            known = self.contexts[k][where] == rest >> 8 if len(self.contexts[k]) else np.zeros(len(rest), bool)
            cost = self._lower(rest, k)
            cost[known] += self.escape[k][where[known]]
            out[~seen] = cost
        return out


class Scorer:
    """PPM lengths of whole texts by direct tables: pairs of bytes -> context number -> code number -> bits."""

    def __init__(self, model: PPM):
        self.model, k = model, model.order
        self.n = len(model.languages)
        contexts = model.contexts[k]
        self.context_of = np.zeros(1 << 16, np.int32)  # of the context's first two bytes (order 3) or all of it (order 2)
        if k == 3:
            pairs = np.unique(contexts >> 8)
            self.context_of[pairs] = np.arange(1, len(pairs) + 1)
            self.third = np.zeros(((len(pairs) + 1) << 8), np.int32)
            self.third[(self.context_of[contexts >> 8].astype(np.int64) << 8) | (contexts & 255)] = np.arange(1, len(contexts) + 1)
            numbers = np.arange(1, len(contexts) + 1)
        else:
            self.third = None
            self.context_of[contexts] = np.arange(1, len(contexts) + 1)
            numbers = np.arange(1, len(contexts) + 1)
        codes = model.codes[k]
        self.gram = np.zeros((len(contexts) + 1) << 8, np.int32)
        own = numbers[np.searchsorted(contexts, codes >> 8)].astype(np.int64)
        self.gram[(own << 8) | (codes & 255)] = np.arange(1, len(codes) + 1)
        self.bits = np.concatenate([np.zeros((1, self.n)), model.bits[k]])

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each text raw[at[i]:at[i + 1]], by language."""
        k, n = self.model.order, len(at) - 1
        total = np.zeros((n, self.n))
        if not len(raw):
            return total
        wide = raw.astype(np.int32)
        owner_starts = at[:-1]
        # bytes with fewer than k bytes before them in their text take the shorter contexts they have
        short = np.zeros(len(raw), bool)
        for j in range(k):
            place = owner_starts + j
            short[place[place < at[1:]]] = True
        if len(raw) > k:
            pair = self.context_of[(wide[:-k] << 8) | wide[1 : len(raw) - k + 1]]
            context = pair if k == 2 else self.third[(pair << 8) | wide[2:-1]]
            gram = self.gram[(context << 8) | wide[k:]]
            gram[short[k:]] = 0
            miss = np.flatnonzero((gram == 0) & ~short[k:]) + k
            edges = np.clip(at - k, 0, len(gram))
            for x in range(self.n):
                sums = np.concatenate([[0.0], np.cumsum(self.bits[gram, x])])
                total[:, x] += sums[edges[1:]] - sums[edges[:-1]]
            if len(miss):
                code = np.zeros(len(miss), np.int64)
                for j in range(k + 1):
                    code = code << 8 | raw[miss - k + j]
                unique, back = np.unique(code, return_inverse=True)
                np.add.at(total, np.searchsorted(at, miss, "right") - 1, self.model.lengths(unique, k)[back])
        for j in range(k):
            has = np.flatnonzero(at[1:] - at[:-1] > j)
            if len(has):
                code = np.zeros(len(has), np.int64)
                for i in range(j + 1):
                    code = code << 8 | raw[at[has] + i]
                total[has] += self.model.lengths(code, j)
        return total


def train(docs: DataFrame, label: str = "lang", per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES, order: int = ORDER) -> PPM:
    """Statistics from rows not held out that have a label: of each language at most per_language documents, the least by
    a hash of their id, and at most max_bytes of whole texts, or the least text where all are larger."""
    rows = docs.where(~common.held_out())
    few = rows.where(F.col(label).isNotNull()).select(label).distinct().limit(MAX_LANGUAGES + 1).collect()
    if len(few) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    ids = common.sample_ids(rows, label, "doc_id", per_language, sorted(r[0] for r in few))
    texts = common.texts_by_id(rows, list(ids.values()), max_bytes)
    return PPM({str(k): list(own.values()) for k, own in zip(ids, texts)}, order)


def predict(docs: DataFrame, model: PPM) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score (the posterior of the predicted language under equal priors).

    `und` with score 0 where the text is null, empty or has no letter, or nothing was learned. Ties go to the language that
    sorts first. Every whole text is scored, whatever its length; repeated rows give repeated results, an empty table none;
    columns besides doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    cache: dict = {}

    def run(batches):
        if "scorer" not in cache:
            cache["scorer"] = Scorer(shared.value) if shared.value.languages else None
        scorer = cache["scorer"]
        names = np.array([*shared.value.languages, "und"], dtype=object)
        for piece in common.slices(batches, 64):
            texts = common.texts_of(piece.column(2))
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if scorer:
                bits = scorer.score(*common.byte_view(piece.column(2)))
                letters = np.array([bool(_LETTER.search(t)) for t in texts], bool)
                found = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
                best = np.where(letters, found, best)
                score = np.where(letters, 1 / np.exp2(-gap).sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Learns from docs and predicts all its rows."""
    return predict(docs, train(docs))
