"""Toxicity by compression distance.

Two zstandard dictionaries are learned from labelled text: one of ordinary text, and one of the same followed by toxic
text, namely the parts of words in toxic documents that are over-represented there. (Dictionaries trained by zstandard on each
class alone hold mostly the words that both classes share and don't tell them apart; the README has the figures.) Every window of a few words is
compressed with each; the bytes that the toxic dictionary saves, their sum over the windows where it saves enough or the
largest of them, whichever calibrates better, are the text's evidence. A threshold on the evidence is calibrated on labelled documents that the dictionaries haven't seen.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that are learned from at most, and their bytes at most.
PER_CLASS, MAX_BYTES = 1200, 16 << 20
#: Words of a window; bytes of the dictionaries' ordinary and toxic text.
WORDS, COMMON_BYTES, TOXIC_BYTES = 8, 4096, 8192
#: Both dictionaries end with HEAD, and each window is compressed between HEAD and TAIL: so every window is worth a compressed
#: block, whose cost cancels out, and matches are also found at its end, where the compressor takes no more.
HEAD, TAIL = bytes((37 * i + 11) % 251 for i in range(96)), bytes(range(1, 9))
#: Bytes of the strings that are compared between the classes.
GRAM = 5
#: A shorter word is written several times over, to as many bytes at least: between spaces the compressor can match it then.
LEAST_WORD = 5
#: Maps A-Z to a-z and every ASCII byte but letters and digits to a space.
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
#: A text is predicted toxic from this score on.
CUT = 0.7


@dataclasses.dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    gain: int = 3  # bytes that a window must save to count
    most: bool = False  # the evidence is the largest saving, not the sum
    threshold: float = 3.0  # of the evidence: the score there is CUT
    scale: float = 1.0


def _words(text: str) -> list[bytes]:
    """The whole text's words: runs of letters, digits and non-ASCII characters, A-Z lower-cased, short ones repeated."""
    own = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return [w if len(w) >= LEAST_WORD else w * -(-LEAST_WORD // len(w)) for w in own]


def _windows(text: str, words: int = WORDS) -> list[bytes]:
    """The whole text in windows of a few words, each with a space around its words."""
    own = _words(text)
    return [b" " + b" ".join(own[k : k + words]) + b" " for k in range(0, len(own), words)]


class Compressor:
    """Lengths of windows compressed with each of the two dictionaries."""

    def __init__(self, model: Model):
        self.model = model
        params = zstandard.ZstdCompressionParameters(
            compression_level=1, strategy=zstandard.STRATEGY_GREEDY, window_log=15, hash_log=15, chain_log=15, search_log=6, min_match=6,
            target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.pair = []
        for raw in (model.ordinary, model.toxic):
            own = zstandard.ZstdCompressionDict(raw + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.pair.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes saved by the toxic dictionary, by window."""
        a, b = (c.compress for c in self.pair)
        framed = [HEAD + w + TAIL for w in windows]
        return np.fromiter((len(a(w)) - len(b(w)) for w in framed), np.int64, len(windows))

    def evidence(self, text: str) -> float:
        windows = _windows(text)
        if not windows or self.model.toxic == self.model.ordinary:
            return 0.0
        return self.gathered(self.gains(windows))

    def gathered(self, gains: np.ndarray) -> float:
        own = gains[gains >= self.model.gain]
        return float(own.max(initial=0) if self.model.most else own.sum())

    def score(self, evidence: float) -> float:
        x = (evidence - self.model.threshold) / self.model.scale + math.log(CUT / (1 - CUT))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _grams(text: str, n: int = GRAM) -> set[bytes]:
    raw = b" " + b" ".join(_words(text)) + b" "
    return {raw[k : k + n] for k in range(len(raw) - n + 1)}


def _toxic_words(toxic: list[str], ordinary: list[str], limit: int) -> bytes:
    """The parts of toxic texts' words that are covered by byte strings found in several of them and, for their share,
    hardly in ordinary ones; those with most evidence, up to limit bytes."""
    there: dict[bytes, int] = {}
    for t in toxic:
        for g in _grams(t):
            there[g] = there.get(g, 0) + 1
    least = max(2, round(0.015 * len(toxic)))
    there = {g: n for g, n in there.items() if n >= least}
    other = dict.fromkeys(there, 0)
    for t in ordinary:
        for g in _grams(t):
            if g in other:
                other[g] += 1
    ratio = len(toxic) / max(len(ordinary), 1)
    marks = {g: n * math.log(n / (ratio * other[g] + 0.5)) for g, n in there.items() if other[g] * ratio <= 0.02 * n}
    found: dict[bytes, int] = {}
    weight: dict[bytes, float] = {}
    for t in toxic:
        for w in set(_words(t)):
            padded = b" " + w + b" "
            at = [k for k in range(len(padded) - GRAM + 1) if padded[k : k + GRAM] in marks]
            while at:  # each run of overlapping marks is one string
                last = next((k for k in range(len(at) - 1) if at[k + 1] - at[k] >= GRAM), len(at) - 1)
                own = padded[at[0] : at[last] + GRAM]
                found[own] = found.get(own, 0) + 1
                weight[own] = max(weight.get(own, 0.0), *(marks[padded[k : k + GRAM]] for k in at[: last + 1]))
                at = at[last + 1 :]
    chosen, size = [], 0
    for own in sorted(found, key=lambda w: (-weight[w], -found[w], w)):
        if size + len(own) <= limit and not any(own in other for other in chosen):
            chosen.append(own)
            size += len(own)
    return b"".join(reversed(chosen))  # the strongest last, where matches cost least


def _common(texts: list[str], limit: int) -> bytes:
    """Ordinary text for both dictionaries, chosen by zstandard's own training on windows of ordinary documents."""
    samples = [w for t in texts for w in _windows(t, 12)]
    try:
        raw = zstandard.train_dictionary(limit + 2048, samples, k=64, d=8).as_bytes()
        return raw[-limit:]
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[:limit]


def _apart(texts: list[str]) -> list[str]:
    """The texts that share no long line with an earlier one: copies must not pass for evidence from several texts."""
    seen, out = set(), []
    for t in texts:
        lines = {x for x in t.split("\n") if len(x) > 40}
        if not lines & seen:
            out.append(t)
        seen |= lines
    return out


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Learns the dictionaries from two thirds of the texts and the threshold from the rest, then the dictionaries from all."""
    if not toxic or not ordinary:
        return Model(b"", b"")

    def learn(a: list[str], b: list[str]) -> Model:
        a = _apart(a)
        base = _common(b, COMMON_BYTES)
        return Model(base, base + _toxic_words(a, b, TOXIC_BYTES))

    part = lambda x, rest: [t for k, t in enumerate(x) if (k % 3 == 0) == rest]
    first = learn(part(toxic, False) or toxic, part(ordinary, False) or ordinary)
    best = None
    c = Compressor(first)
    yes, no = ([c.gains(_windows(t)) for t in part(x, True)] for x in (toxic, ordinary))
    for gain in (3, 4, 5):
        for most in (False, True):
            c.model = dataclasses.replace(first, gain=gain, most=most)
            up, down = (np.array([c.gathered(g) for g in x]) for x in (yes, no))
            for cut in range(gain, gain + 10):
                # both classes' error shares, that of ordinary text twice; of equal ones the first
                error = float((up < cut).mean() if len(up) else 0) + 2 * float((down >= cut).mean() if len(down) else 0)
                if best is None or error < best[0] - 1e-9:
                    best = (error, gain, most, cut)
    _, gain, most, cut = best
    model = learn(toxic, ordinary)
    return dataclasses.replace(model, gain=gain, most=most, threshold=float(cut), scale=max(0.5, cut / 4))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """Learns from labelled rows not held out: of each class at most per_class documents, the least by a hash of their id,
    and at most max_bytes of whole texts, or the least text where all are larger.
    A document with conflicting labels counts as toxic; labels other than 0 and 1 are ignored. Without documents of either
    class nothing is learned and every text has the score of an empty one."""
    marks = (
        labels.where(F.col("toxic").isin(0, 1) & ~common.held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    ids = common.sample_ids(marks, "toxic", "doc_id", per_class, [0, 1])
    texts = common.texts_by_id(docs, [ids.get(1, []), ids.get(0, [])], max_bytes)
    return fit(*([t for t in own.values() if t] for own in texts))


def score(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Null and empty texts have no evidence and score like an empty
    one; repeated rows give repeated results, an empty table none. Texts of any length are scored whole, window by window, and
    equal evidence gives equal scores. With carry the columns of docs come back, whatever their names, with __toxic_score."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    cache: dict = {}
    at = docs.columns.index("text") if carry else 2
    kept = docs.columns

    def run(batches):
        if "own" not in cache:
            cache["own"] = Compressor(shared.value)
        own = cache["own"]
        for piece in common.slices(batches):
            scores = [own.score(own.evidence(t)) for t in common.texts_of(piece.column(at))]
            s = pa.array(scores, pa.float64())
            if carry:
                yield pa.RecordBatch.from_arrays([*piece.columns, s], [*kept, "__toxic_score"])
            else:
                p = pa.array([int(x >= CUT) for x in scores], pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), s, p], ["doc_id", "held_out", "score", "predicted"])

    if carry:
        from pyspark.sql.types import DoubleType, StructType

        return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("__toxic_score", DoubleType()))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs not predicted toxic, with their columns; the model learns from docs and labels."""
    scored = score(docs, train(docs, labels), carry=True)
    return scored.where(F.col("__toxic_score") < CUT).select(*[F.col(f"`{c}`") for c in docs.columns])
