"""Secret scanning: base patterns, and a character convolutional network over every candidate and its surroundings.

Candidates are the base patterns' matches and all runs of LEAST or more token characters that hold a digit or a capital.
The network is trained in numpy on labelled findings: the base matches of a sample of the corpus, and findings made by rule
(keys of many formats against identifiers, numbers, paths and the like, set into words of that sample). A long candidate is
scored in overlapping pieces, and the largest score counts; scores are calibrated, and the thresholds, one for each shape of
candidate, are the highest that keep the recall asked for on findings not trained on, of either origin. Candidates from their threshold on that touch no base match become spans of
kind `model`; base spans stay whatever the network says.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
#: Least lengths: of an assigned value, an access key, a hexadecimal run, a candidate.
ASSIGNED, ACCESS_LENGTH, HEX_LENGTH, LEAST = 8, 16, 32, 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Of these a candidate has one at least.
MARKS = frozenset(string.digits + string.ascii_uppercase)
#: Characters before, of and after a candidate that the network sees.
BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH = BEFORE + INSIDE + AFTER
#: Documents (the least by a hash of their id, CONTEXT_BYTES of text at most) whose words surround the labelled findings, findings, and the recall that the threshold must keep.
CONTEXTS, CONTEXT_BYTES, FINDINGS, RECALL = 200, 4 << 20, 4000, 0.98
#: Findings of a shape, not trained on, that its own threshold needs.
LEAST_OF_SHAPE = 30
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base findings, code points, end exclusive, by start and kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of token characters with a digit or a capital, without punctuation at their ends, in order."""
    out = []
    for m in RUN.finditer(text):
        own = m[0].strip("./_-")
        if len(own) >= LEAST and any(c in MARKS for c in own):
            start = m.start() + m[0].index(own)
            out.append((start, start + len(own)))
    return out


def worth_a_look(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of texts in one byte array: which can hold a finding or candidate. Runs of token bytes are measured at once."""
    n = len(at) - 1
    out = np.zeros(n, bool)
    if not len(raw):
        return out
    token = _TOKEN[raw]
    begin, end = token.copy(), token.copy()
    begin[1:] &= ~token[:-1]
    end[:-1] &= ~token[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    begin[edges] = token[edges]
    end[edges - 1] = token[edges - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = last - first >= LEAST
    first, last = first[long], last[long]
    marked = np.concatenate([[0], np.cumsum(_MARK[raw], dtype=np.int32)])
    hit = first[(marked[last] > marked[first]) | (last - first >= HEX_LENGTH)]
    marks = np.flatnonzero((raw == 0x3A) | (raw == 0x3D))
    for places in (hit, marks):
        out[np.searchsorted(at, places, "right") - 1] = True
    return out


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate in overlapping pieces of INSIDE characters, the last one at its end; a short one is its own piece."""
    last = max(start, end - INSIDE)
    return [(at, min(end, at + INSIDE)) for at in (*range(start, last, INSIDE // 2), last)]


def encode(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers around a piece of a candidate, and where the piece is."""
    left, right = max(0, start - BEFORE), min(end, start + INSIDE)
    x, inside = np.zeros(LENGTH, np.int8), np.zeros(LENGTH, np.float32)
    for place, part in ((BEFORE - (start - left), text[left:start]), (BEFORE, text[start:right]), (BEFORE + INSIDE, text[end : end + AFTER])):
        for k, c in enumerate(part):
            o = ord(c)
            x[place + k] = o - 30 if 32 <= o < 127 else 1
    inside[BEFORE : BEFORE + right - start] = 1
    return x, inside


@dataclasses.dataclass
class CharCNN:
    """Embedding, one convolution, maximum over places, a hidden layer, a calibrated logistic output."""

    weights: dict
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    limits: dict = dataclasses.field(default_factory=dict)  # thresholds by shape; the one above for shapes with few findings

    CHARS, DIM, WIDTH, FILTERS, HIDDEN = 97, 12, 5, 24, 16

    @classmethod
    def new(cls, seed: int = 11) -> CharCNN:
        rng = np.random.default_rng(seed)
        shapes = {"e": (cls.CHARS, cls.DIM), "i": (cls.DIM,), "w": (cls.WIDTH * cls.DIM, cls.FILTERS), "b": (cls.FILTERS,), "u": (cls.FILTERS, cls.HIDDEN), "c": (cls.HIDDEN,), "v": (cls.HIDDEN,), "d": (1,)}
        own = {k: (rng.normal(size=s) * (0.3 if k == "e" else (2 / s[0]) ** 0.5)).astype(np.float32) for k, s in shapes.items()}
        return cls(own | {k: np.zeros(shapes[k], np.float32) for k in ("b", "c", "d")})

    def _forward(self, x: np.ndarray, inside: np.ndarray):
        w = self.weights
        e = w["e"][x] + inside[:, :, None] * w["i"]
        cols = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - self.WIDTH + 1, -1)
        z = cols @ w["w"] + w["b"]
        top = z.argmax(axis=1)
        m = np.maximum(np.take_along_axis(z, top[:, None, :], axis=1)[:, 0], 0)
        h = np.maximum(m @ w["u"] + w["c"], 0)
        return h @ w["v"] + w["d"][0], (cols, top, m, h)

    def train(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 3e-3, seed: int = 5) -> None:
        rng, w = np.random.default_rng(seed), self.weights
        first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), 128):
                own = order[k : k + 128]
                out, (cols, top, m, h) = self._forward(x[own], inside[own])
                n = len(own)
                d_out = ((1 / (1 + np.exp(-out)) - y[own]) / n).astype(np.float32)
                d_h = np.outer(d_out, w["v"]) * (h > 0)
                d_m = (d_h @ w["u"].T) * (m > 0)
                picked = np.take_along_axis(cols, top[:, :, None], axis=1)  # n x filters x (width dim)
                g = {"v": h.T @ d_out, "d": d_out.sum(keepdims=True), "u": m.T @ d_h, "c": d_h.sum(axis=0), "b": d_m.sum(axis=0), "w": np.einsum("nfc,nf->cf", picked, d_m)}
                d_cols = (d_m[:, :, None] * w["w"].T[None]).reshape(n, self.FILTERS, self.WIDTH, self.DIM)
                place = top[:, :, None] + np.arange(self.WIDTH)
                row = np.broadcast_to(np.arange(n)[:, None, None], place.shape)
                g["e"] = np.zeros_like(w["e"])
                np.add.at(g["e"], x[own][row, place], d_cols)
                g["i"] = (d_cols * inside[own][row, place][..., None]).sum(axis=(0, 1, 2))
                step += 1
                for p, v in g.items():
                    first[p] = 0.9 * first[p] + 0.1 * v
                    second[p] = 0.999 * second[p] + 0.001 * v * v
                    w[p] -= (rate * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)

    def calibrate(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray, shapes: np.ndarray | None = None, recall: float = RECALL) -> None:
        """Platt scaling, then the highest thresholds that keep the recall, over all findings and of each shape."""
        out = self._forward(x, inside)[0].astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30)))
            a -= 0.05 * float(((p - y) * out).mean()) / max(1.0, float((out * out).mean()) ** 0.5)
            b -= 0.5 * float((p - y).mean())
        self.slope, self.shift = a, b
        scores = self.scores(x, inside)
        highest = lambda own: float(np.sort(own)[int((1 - recall) * len(own))])
        self.threshold = highest(scores[y == 1]) if (y == 1).any() else 1.0
        for s in set(shapes.tolist()) if shapes is not None else ():
            own = scores[(y == 1) & (shapes == s)]
            if len(own) >= LEAST_OF_SHAPE:
                self.limits[s] = highest(own)

    def scores(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = self._forward(x, inside)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))


def shape(value: str) -> int:
    """0 for hexadecimal digits only, 1 with signs, 2 for other letters and digits."""
    return 0 if re.fullmatch("[0-9a-fA-F]+", value) else 1 if not value.isalnum() else 2


def limit(net: CharCNN, value: str) -> float:
    """The threshold that the score of this candidate must reach."""
    return getattr(net, "limits", {}).get(shape(value), net.threshold)


def best_scores(net: CharCNN, text: str, places: list[tuple[int, int]]) -> np.ndarray:
    """Of each place in the text the largest score of any of its pieces."""
    parts = [(k, *p) for k, (a, b) in enumerate(places) for p in pieces(a, b)]
    out = np.zeros(len(places))
    for at in range(0, len(parts), 512):
        few = parts[at : at + 512]
        own = [encode(text, a, b) for _, a, b in few]
        np.maximum.at(out, [k for k, _, _ in few], net.scores(np.array([o[0] for o in own]), np.array([o[1] for o in own])))
    return out


def labelled_findings(contexts: list[str], n: int = FINDINGS, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of findings made by rule, half of them secrets, between words of the contexts."""
    rng = np.random.default_rng(seed)
    words = [w for t in contexts for w in t.split()] or ["the", "value", "of", "it"]
    chars = {"62": string.ascii_letters + string.digits, "36": string.ascii_lowercase + string.digits, "AZ": string.ascii_uppercase + string.digits, "16": "0123456789abcdef", "64": string.ascii_letters + string.digits + "+/"}
    some = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    pick = lambda own: own[int(rng.integers(0, len(own)))]
    digits = lambda k: some(string.digits, k)
    letters = lambda low, high: some(string.ascii_lowercase, int(rng.integers(low, high)))
    plain = [w for w in (re.sub(r"[^a-z]", "", w.lower()) for w in words) if len(w) > 2] or ["word"]

    def secret() -> str:
        kind = int(rng.integers(0, 6))
        if kind == 0:
            return pick(["AKIA", "ASIA"]) + some(chars["AZ"], 16)
        if kind == 1:
            return some(chars["16"], int(pick([18, 24, 32, 40, 64])))
        if kind == 2:
            return letters(2, 4) + pick("_-") + some(chars["62"], int(rng.integers(20, 44)))
        if kind == 3:
            return some(chars["64"], int(rng.integers(20, 60))) + pick(["", "=", "=="])
        if kind == 4:
            return "eyJ" + some(chars["62"], 20) + "." + some(chars["62"], 24)
        return some(chars["62"], int(rng.integers(20, 40)))

    def ordinary() -> str:
        kind = int(rng.integers(0, 11))
        if kind == 0:
            return digits(int(rng.integers(16, 20)))
        if kind == 1:
            return pick("_-.").join([pick(plain), pick(plain), pick(plain)]) + pick(["-", "_", ""]) + digits(int(rng.integers(1, 5)))
        if kind == 2:
            return "/".join([pick(plain), pick(plain), pick(plain) + digits(2) + pick([".html", ".py", ".txt"])])
        if kind == 3:
            return f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}.{digits(2)}.{digits(2)}"
        if kind == 4:
            return "".join(pick(plain) for _ in range(5)) + digits(1)
        if kind == 5:
            return "www." + pick(plain) + pick(plain) + pick([".com/", ".org/"]) + pick(plain) + digits(int(rng.integers(1, 6)))
        if kind == 6:
            return "-".join([digits(3), digits(4), digits(4), digits(4)])
        if kind == 7:
            return pick(plain) * int(rng.integers(3, 6)) + "=" + digits(2)
        several = [pick(plain) for _ in range(int(rng.integers(3, 9)))]  # no digits: names, titles and paths with capitals
        if kind == 8:
            return "".join(w.capitalize() for w in several)
        if kind == 9:
            return pick("_-.").join(w.upper() for w in several)
        return pick("/-._").join(w.capitalize() if rng.random() < 0.6 else w for w in [pick(plain).capitalize(), *several])

    lead = ["", "", "", "token = \"", "password=", "key: ", "secret ", "Authorization: Bearer "]
    out = []
    for k in range(n):
        label = k % 2
        value = secret() if label else ordinary()
        value += "" if len(value) >= LEAST else some(chars["16"] if label else "x1", LEAST - len(value))
        own = [pick(words) for _ in range(8)]
        before = " ".join(own[:4]) + " " + (pick(lead) if label or rng.random() < 0.1 else pick(lead[:3]))
        out.append((before + value + pick(["", ".", "\"", ","]) + " " + " ".join(own[4:]), len(before), len(before) + len(value), label))
    return out


def base_findings(contexts: list[str], most: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, 1) of the base matches of the contexts, each cut to a piece at its end; at most so many."""
    found = ((t, max(a, b - INSIDE), b, 1) for t in contexts for a, b, _ in base_spans(t))
    return list(itertools.islice(found, most))


def train(contexts: list[str], findings: int = FINDINGS) -> CharCNN:
    made = labelled_findings(contexts, findings) + base_findings(contexts, findings)
    own = [encode(t, a, b) for t, a, b, _ in made]
    x, inside = np.array([o[0] for o in own]), np.array([o[1] for o in own])
    y = np.array([m[3] for m in made], np.float32)
    rest = np.arange(len(y)) % 5 == 4
    net = CharCNN.new()
    shapes = np.array([shape(t[a:b]) for t, a, b, _ in made])
    net.train(x[~rest], inside[~rest], y[~rest])
    net.calibrate(x[rest], inside[rest], y[rest], shapes[rest])
    return net


def contexts_of(docs: DataFrame, n: int = CONTEXTS) -> list[str]:
    """Texts of a bounded sample, the least by a hash of the id."""
    ids = common.sample_ids(docs.select(F.lit(1).alias("one"), "doc_id"), "one", "doc_id", n, [1]).get(1, [])
    return list(common.texts_by_id(docs, [ids], CONTEXT_BYTES)[0].values())


SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint, max_score double"
)


def findings_of(text: str, net: CharCNN) -> tuple[list, list, float | None]:
    """(base spans, added spans, best score of any candidate) of one text."""
    base = base_spans(text)
    places = sorted({(a, b) for a, b, _ in base} | set(candidates(text)))
    if not places:
        return base, [], None
    scores = best_scores(net, text, places)
    starts = np.array([s[0] for s in base], np.int64)
    reach = np.maximum.accumulate(np.array([s[1] for s in base], np.int64)) if base else starts
    added = []
    for (a, b), s in zip(places, scores):
        k = int(np.searchsorted(starts, b, "left"))  # base spans that start before b
        if s >= limit(net, text[a:b]) and not (k and reach[k - 1] > a):
            added.append((a, b, 3))
    return base, added, float(scores.max())


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def scan(docs: DataFrame, net: CharCNN) -> DataFrame:
    """Per row of docs: counts of the base findings, the digest of their spans, all spans, the network's own, the best score.

    A null text is empty: no spans, the digest of no bytes, a null max_score. Repeated rows give repeated results. Texts and
    candidates of any length are read whole. Spans that begin at one place come in the order of KINDS; equal scores need no
    order, for every candidate is judged by itself. An empty table gives no rows; columns besides doc_id and text are not
    looked at.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    none = ([], [], None)

    def run(batches):
        for piece in common.slices(batches):
            look = worth_a_look(*common.byte_view(piece.column(1)))
            texts = piece.column(1)
            out = {n: [] for n in names[1:]}
            for k in range(piece.num_rows):
                base, added, best = findings_of(texts[k].as_py() or "", shared.value) if look[k] else none
                for kind in range(3):
                    out[names[1 + kind]].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
                out["spans"].append(_written(base + added))
                out["n_model"].append(len(added))
                out["max_score"].append(best)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(out[n], t) for n, t in zip(names[1:], types)]], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def scan_documents(docs: DataFrame) -> DataFrame:
    return scan(docs, train(contexts_of(docs)))
