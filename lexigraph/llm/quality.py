"""Quality classifier: a naive Bayes support vector machine over n-gram indicators.

A text sets three groups of indicators:

* form: its bytes are mapped to 32 character classes; each class 3-gram that occurs, each that
  makes up at least a 64th of the text, and how often a word repeats the one before it (as powers
  of two);
* words: each lower-case word and each pair of neighbouring words, hashed;
* letters: each run of four bytes of the lower-case text, hashed.

For the training sample, each feature is scaled by its class log-count ratio
r = log((p/|p|) / (q/|q|)); hashed features that fewer than ``LEAST`` rows set have r = 0. So that
a long text isn't judged by its number of words, the hashed groups are scaled by the root of how
many known features the text sets. A linear hinge-loss model is fitted to the scaled indicators by
dual coordinate descent, and its weights are drawn towards their mean magnitude. A logistic curve
over margins of rows left out of the fit turns margins into scores.

The sample is bounded by ``sample`` labelled rows, those with the smallest hash of doc_id; feature
numbers come to the driver, no text. Scoring is one narrow pass over whole texts with a broadcast
of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, extended, mixed, raw_texts, release, slices, with_columns, word_hashes

# Character classes: lower-case letters and bytes beyond ASCII 0, upper-case 1, digits 2, blanks 3, line breaks 4, then
# single marks in this order; square and curly brackets share one, and the rest share the last.
MARKS = ".,!?%&$#*|<>()[{\"'-_/:;=@+"
CLASSES = np.full(256, 31, np.int64)
CLASSES[97:123] = CLASSES[128:] = 0
CLASSES[65:91], CLASSES[48:58] = 1, 2
CLASSES[[32, 9, 11, 12]], CLASSES[[10, 13]] = 3, 4
for _i, _c in enumerate(MARKS):
    CLASSES[ord(_c)] = 5 + _i
CLASSES[ord("]")], CLASSES[ord("}")] = CLASSES[ord("[")], CLASSES[ord("{")]
GRAMS = 32**3
DENSE = 64
FORM = 2 * GRAMS + 64
HASHED = 1 << 17
#: Where each group of features begins, and the end.
GROUPS = [0, FORM, FORM + HASHED, FORM + 2 * HASHED]
SIZE = GROUPS[-1]
LEAST = 3
LOUD = 4.0
PAIR = U64(0x9E3779B97F4A7C15)


def folded(keys: np.ndarray, start: int) -> np.ndarray:
    """Distinct numbers of hashed features, ascending."""
    return np.unique(keys & U64(HASHED - 1)).astype(np.int64) + start


def features(raw: bytes) -> np.ndarray:
    """The numbers of the indicators that a text sets, ascending within each group and between groups."""
    low = raw.lower()
    c = CLASSES[np.frombuffer(raw, np.uint8)]
    h = word_hashes(low.split())
    again = int((h[1:] == h[:-1]).sum()) if len(h) > 1 else 0
    extra = [2 * GRAMS + again.bit_length(), 2 * GRAMS + 32 + (32 * again // len(h) if len(h) else 31)]
    form = [np.array(extra, np.int64)]
    if len(c) >= 3:
        counts = np.bincount(c[:-2] << 10 | c[1:-1] << 5 | c[2:], minlength=GRAMS)
        some = np.flatnonzero(counts)
        form = [some, some[counts[some] * DENSE >= len(c)] + GRAMS, *form]
    b = np.frombuffer(low, np.uint8).astype(U64)
    runs = b[:-3] << U64(24) | b[1:-2] << U64(16) | b[2:-1] << U64(8) | b[3:] if len(b) > 3 else b[:0]
    words = np.concatenate((mixed(h), mixed(h[:-1] * PAIR + h[1:])))
    return np.concatenate((*form, folded(words, GROUPS[1]), folded(mixed(np.unique(runs)), GROUPS[2])))


def scales(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The factor of each of a text's features: 1 for form, else ``LOUD`` by the root of the known features of the group."""
    out = np.ones(len(x))
    edges = np.searchsorted(x, GROUPS[1:]) if len(x) else np.zeros(3, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = LOUD / np.sqrt(max(1, int(known[x[a:b]].sum())))
    return out


@dataclass
class Model:
    """Weights with r already in them, and which features are known (r other than 0)."""

    weights: np.ndarray
    known: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x] @ scales(x, self.known) + self.bias)

    def score(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(raw)) + self.offset, -30, 30))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int = 0, settled: float = 1e-2) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for a linear hinge loss; ``values``: those of each row's features; the bias is one more feature."""
    w, b, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([v @ v + 1 for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                b += step
                most = max(most, abs(gradient))
                alpha[i] = new
        if most < settled:
            break
    return w, b


def ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    """The class log-count ratio of each feature; 0 for hashed ones that fewer than ``LEAST`` rows set."""
    p, q = np.zeros(size), np.zeros(size)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    r = np.log(((p + smoothing) / (p + smoothing).sum()) / ((q + smoothing) / (q + smoothing).sum()))
    r[FORM:][(p + q)[FORM:] < LEAST] = 0
    return r


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int = SIZE, smoothing: float = 1.0, cost: float = 0.1, mix: float = 0.5, epochs: int = 12) -> Model:
    """A model from features and 0/1 labels; without both classes, the constant score of the one there is (0.5 without rows)."""
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        return Model(np.zeros(size), np.zeros(size, bool), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % 5 == 0
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    y = np.where(labels == 1, 1.0, -1.0)
    fitted = np.flatnonzero(~held)
    own = [rows[i] for i in fitted]
    r = ratios(own, y[fitted], size, smoothing)
    known = r != 0
    own = [x[known[x]] for x in own]
    n1 = max(1, int((y[fitted] > 0).sum()))
    balance = np.where(y[fitted] > 0, len(fitted) / (2 * n1), len(fitted) / (2 * max(1, len(fitted) - n1)))
    w, b = descend(own, [r[x] * scales(x, known) for x in own], y[fitted], cost * balance, size, epochs)
    w = (1 - mix) * np.abs(w[w != 0]).mean() + mix * w if w.any() else w
    model = Model(w * r, known, float(b), 0.0, 0.0)
    judged = np.flatnonzero(held) if held.any() else fitted
    model.slope, model.offset = _logistic(np.array([model.margin(rows[i]) for i in judged]), labels[judged])
    return model


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the smoothed logistic curve (Newton steps with a small ridge)."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    scale = margin.std() or 1.0
    x = np.stack((margin / scale, np.ones_like(margin)), 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (t - [1, 0]))
        t = t - np.clip(step, -2, 2)
    return float(t[0] / scale), float(t[1])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = 4096, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from the labelled rows for which ``allowed`` (over doc_id) holds.

    Rows with a null id, a label other than 0 or 1, or contradicting labels of one id don't
    count; a null text counts as empty.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & allowed).groupBy(doc_id).agg(F.min(label).alias("_lx_label"), F.max(label).alias("_lx_most"))
    drawn = known.where("_lx_label = _lx_most").orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    chosen = docs.join(F.broadcast(drawn.select(doc_id, "_lx_label")), doc_id).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col("_lx_label").cast("int").alias("y"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(r).astype(np.int32).tobytes() for r in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary()), batch.column("y")], names=["id", "f", "y"])

    # A repeated doc_id counts once, by the least of its rows' features.
    once = chosen.mapInArrow(extract, "id long, f binary, y int").groupBy("id").agg(F.min("f").alias("f"), F.min("y").alias("y"))
    got = sorted(((r.id, r.y, np.frombuffer(bytes(r.f), np.int32)) for r in once.toLocalIterator()), key=lambda r: r[0])
    model = fit([f for _, _, f in got], np.array([y for _, y, _ in got], np.int64))
    del got
    release()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with their score, 0 to 1. Null and empty texts are scored like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(docs.schema, (name, T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                columns = with_columns(batch, {name: pa.array([model.score(r) for r in raw_texts(batch.column(text))], pa.float64())})
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])
        release()

    return docs.mapInArrow(run, schema)
