"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of equal length; every passage of the whole text is encoded. A
hidden layer, a gated attention (tanh times sigmoid) and a logistic output are learned from
document labels alone; a document's score is that of its attention-weighted passage
representation. Fitting uses a bounded sample of labelled rows (``TRAIN_ROWS`` documents, the
smallest under a hash of the identifier) and every passage of each; scoring reads every passage of
every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import id_hash, raw_texts, short_batches, utf8

PASSAGE_BYTES = 1024
TRAIN_ROWS = 4000
THRESHOLD = 0.7
HIDDEN, GATE, STEPS = 24, 12, 160
FEATURES = 260
_BLOCK = 2 << 20
#: Passages weighed at once, in whole documents.
_AT_ONCE = 4096


def encode_passages(raw: bytes) -> np.ndarray:
    """(passages, FEATURES) float32: root frequencies of the bytes, how far the passage compresses,
    its share of word starts and of words that repeat the word before, and its length. An empty
    text is one empty passage."""
    return np.concatenate([_encode(raw[at : at + _BLOCK]) for at in range(0, max(len(raw), 1), _BLOCK)])


def _encode(raw: bytes) -> np.ndarray:
    n = max(1, -(-len(raw) // PASSAGE_BYTES))
    out = np.zeros((n, FEATURES), np.float32)
    if not raw:
        return out
    octets = np.frombuffer(raw, np.uint8)
    at = (np.arange(len(octets)) // PASSAGE_BYTES) * 256 + octets
    size = np.full(n, PASSAGE_BYTES, np.float32)
    size[-1] = len(raw) - (n - 1) * PASSAGE_BYTES
    counts = np.bincount(at, minlength=n * 256).reshape(n, 256)
    out[:, :256] = np.sqrt(counts / size[:, None])
    out[:, 259] = size / PASSAGE_BYTES
    for k in range(n):
        part = raw[k * PASSAGE_BYTES : (k + 1) * PASSAGE_BYTES]
        words = part.lower().split()
        out[k, 256] = len(zlib.compress(part, 1)) / (len(part) + 24)
        out[k, 257] = 8 * len(words) / len(part)
        out[k, 258] = sum(map(bytes.__eq__, words[1:], words)) / max(1, len(words))
    return out


class GatedAttention:
    """Hidden layer, gated attention, logistic output; plain arrays, so it ships as bytes."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, params: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = params, mean, scale

    @classmethod
    def fresh(cls, mean, scale, seed: int = 17) -> GatedAttention:
        g = np.random.default_rng(seed)
        draw = lambda *s: g.normal(0, 1 / np.sqrt(s[0]), s)
        shapes = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
        return cls(shapes, mean, scale)

    def _forward(self, x, first):
        """x: passages; first: where each document's passages begin."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -60, 60)))
        e = (t * s) @ p["w"]
        many = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), many))
        a = e / np.repeat(np.add.reduceat(e, first), many)
        z = np.add.reduceat(a[:, None] * h, first)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -60, 60)))
        return h, t, s, a, z, score, many

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, first)[5]

    def _gradient(self, x, first, y, n: int) -> dict[str, np.ndarray]:
        """The loss's gradient over some of n documents."""
        p = self.p
        x = (x - self.mean) / self.scale
        h, t, s, a, z, score, many = self._forward(x, first)
        do = (score - y) / n
        dz = np.repeat(do[:, None] * p["c"], many, axis=0)
        dh, da = a[:, None] * dz, (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), many))
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ do, "d": np.array([do.sum()])}

    def fit(self, x, first, y, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> GatedAttention:
        """Full gradient steps; a step's passages are weighed a few documents at a time."""
        parts = [(x[first[i] : first[j] if j < len(y) else len(x)], first[i:j] - first[i], y[i:j]) for i, j in _together(first, len(x))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            p, grad = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
            for part in parts:
                for k, g in self._gradient(*part, len(y)).items():
                    grad[k] += g
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _together(first: np.ndarray, passages: int) -> list[tuple[int, int]]:
    """Ranges of documents of about ``_AT_ONCE`` passages; a longer document is a range of its own."""
    out, at = [], 0
    ends = [*first[1:].tolist(), passages]
    for k, end in enumerate(ends):
        if end - first[at] >= _AT_ONCE or k == len(ends) - 1:
            out.append((at, k + 1))
            at = k + 1
    return out


def _training_bags(batches):
    for batch in batches:
        bags = [encode_passages(v.as_py()).astype(np.float16).tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["doc_id", "y", "bag"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS):
    """Fit on labelled rows whose identifier's crc32 modulo 4 isn't 2. A document with several
    labels counts by its smallest. Returns a :class:`GatedAttention`, or a constant score if there
    is nothing to tell apart: the one label seen, or 1.0 without any."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter("doc_id is not null and y is not null")
        .filter(id_hash("doc_id", 4) != 2)
        .groupBy("doc_id")
        .agg(F.least(F.min("y"), F.lit(1)).alias("y"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most train_rows rows of two numbers: a bound that holds at any size.
    bags = raw_texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").mapInArrow(_training_bags, "doc_id long, y int, bag binary")
    rows = sorted(bags.orderBy(F.xxhash64("doc_id"), "doc_id", "bag").limit(train_rows).collect())
    y = np.array([max(r.y, 0) for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return float(y[0]) if len(rows) else 1.0
    each = [np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate(each)
    first = np.concatenate(([0], np.cumsum([len(b) for b in each])[:-1]))
    total, square = np.zeros(FEATURES), np.zeros(FEATURES)
    for i, j in _together(first, len(x)):
        part = x[first[i] : first[j] if j < len(first) else len(x)].astype(np.float64)
        total += part.sum(0)
        square += (part * part).sum(0)
    mean = total / len(x)
    scale = np.sqrt(np.maximum(square / len(x) - mean * mean, 0)) + 0.02
    return GatedAttention.fresh(mean, scale).fit(x, first, y)


def _scoring(model):
    """Arrow column of UTF-8 texts to their scores, batch by batch, as a column function."""
    if isinstance(model, GatedAttention):
        model = GatedAttention({k: v.astype(np.float32) for k, v in model.p.items()}, model.mean.astype(np.float32), model.scale.astype(np.float32))

    def scores(texts: pa.Array) -> np.ndarray:
        if not isinstance(model, GatedAttention):
            return np.full(len(texts), model, float)
        out, bags, held, at = np.empty(len(texts)), [], 0, 0
        for k, v in enumerate(texts):
            bags.append(encode_passages(v.as_py()))
            held += len(bags[-1])
            if held > _AT_ONCE or k == len(texts) - 1:
                first = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
                out[at : k + 1] = model.scores(np.concatenate(bags), first)
                bags, held, at = [], 0, k + 1
        return np.clip(out, 0, 1)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(texts), pa.float64())

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; empty and null texts are
    scored as an empty passage, repeated rows come back repeated, equal texts score alike. A null
    identifier counts as not held out."""
    short_batches(docs.sparkSession)
    model = fit_quality(docs, labels, id_col, text_col, label_col)
    scored = raw_texts(docs, id_col, text_col).select("doc_id", _scoring(model)("raw").alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(id_hash("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``: a row is judged by its
    own text, whatever other rows have its identifier. Only the text goes to Python, and only its
    score comes back."""
    short_batches(docs.sparkSession)
    model = fit_quality(docs, labels, id_col, text_col)
    return docs.filter(_scoring(model)(utf8(text_col)) >= threshold)
