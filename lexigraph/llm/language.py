"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and labels every byte with a probability of
each language; a document's probabilities pool the log probabilities of the bytes of its words.
Words are runs of ASCII letters and of bytes beyond ASCII, A-Z lower-cased, with one blank between
them; digits, marks and white space are blanks, which the network reads but doesn't label.

A text is read in chunks of ``CHUNK`` bytes, side by side. So that states don't start anew there,
each direction first reads the ``CONTEXT`` bytes before its chunk; characters are never cut. Every
byte of a whole text is labelled once, and a text's result doesn't depend on the texts beside it.

Training, in numpy on the driver: backpropagation through time with Adam, over chunks drawn from
the whole texts of a bounded sample of labelled rows: of each language, those with the smallest
hash of doc_id, so a rare language is learned as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, raw_texts, release, slices, with_columns

CHUNK, CONTEXT = 176, 16
SIDE = 1024
UNKNOWN = "und"
TO_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters_of(raw: bytes) -> bytes:
    """The text's words with one blank between them."""
    return b" ".join(raw.translate(TO_LETTERS).split())


def aligned(buffer: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The places moved back to where a character begins, not below ``low``."""
    for _ in range(3):
        inside = (at > low) & (at < len(buffer))
        at = at - (inside & ((buffer[np.minimum(at, len(buffer) - 1)] & 0xC0) == 0x80))
    return at


def chunked(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = CHUNK, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """(document, first, last, begin, end) of each chunk [first, last) of the documents [starts, ends) of a buffer, read from begin to end."""
    n = -(-(ends - starts) // chunk)
    doc = np.repeat(np.arange(len(starts)), n)
    low, high = starts[doc], ends[doc]
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = aligned(buffer, low + k * chunk, low)
    last = np.where(k + 1 < n[doc], aligned(buffer, low + (k + 1) * chunk, low), high)
    return doc, first, last, aligned(buffer, np.maximum(low, first - context), low), np.where(last + context < high, aligned(buffer, last + context, low), high)


def has_letter(raw: bytes) -> bool:
    return any(97 <= b <= 122 for b in raw.translate(TO_LETTERS)) or (not raw.isascii() and any(c.isalpha() for c in raw.decode()))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, word), 0 beyond the end, and lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(n.max(initial=1))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out.T.copy(), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name: embedding E; per direction d input Wd, recurrent Ud (three gates) and bias bd; output V and c."""

    weights: dict[str, np.ndarray]
    langs: list[str]

    @classmethod
    def new(cls, langs: list[str], hidden: int = 12, embed: int = 12, seed: int = 0) -> Network:
        g = np.random.default_rng(seed)
        make = lambda a, b: (g.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        w = {"E": make(256, embed) * np.float32(np.sqrt(256) * 0.5), "V": make(2 * hidden, len(langs)), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            w |= {f"W{d}": make(embed, 3 * hidden), f"U{d}": make(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}
        return cls(w, langs)

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, word, hidden); a step beyond a word's end leaves its state as it is."""
        w, h = self.weights, self.weights[f"U{d}"].shape[0]
        table = w["E"] @ w[f"W{d}"] + w[f"b{d}"]
        u, state = w[f"U{d}"], np.zeros((x.shape[1], h), np.float32)
        out, tape = np.empty((*x.shape, h), np.float32), []
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            a, m = table[x[t]], mask[t][:, None]
            r_z = _sigmoid(a[:, : 2 * h] + state @ u[:, : 2 * h])
            r, z = r_z[:, :h], r_z[:, h:]
            s = r * state
            n = np.tanh(a[:, 2 * h :] + s @ u[:, 2 * h :])
            new = np.where(m, z * state + (1 - z) * n, state)
            if keep:
                tape.append((t, state, r, z, s, n))
            out[t] = state = new
        return out, tape

    def _states(self, d: str, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The states of ``_direction`` without what training needs, in place; sigmoids are halves of tanh."""
        w, h = self.weights, self.weights[f"U{d}"].shape[0]
        half = np.repeat(np.float32([0.5, 1.0]), [2 * h, h])
        table, u = (w["E"] @ w[f"W{d}"] + w[f"b{d}"]) * half, w[f"U{d}"] * half
        gates, fresh, whole = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :]), mask.all(1)
        state, out = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape, h), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            a = table[x[t]]
            g = state @ gates
            g += a[:, : 2 * h]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            n = (g[:, :h] * state) @ fresh
            n += a[:, 2 * h :]
            np.tanh(n, out=n)
            new = np.subtract(state, n, out=out[t])
            new *= g[:, h:]
            new += n
            if not whole[t]:
                np.copyto(new, state, where=~mask[t][:, None])
            state = new
        return out

    def labels(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log probabilities (time, word, language) of every position."""
        mask, h = np.arange(x.shape[0])[:, None] < n, self.weights["Uf"].shape[0]
        o = self._states("f", x, mask) @ self.weights["V"][:h]
        o += self._states("b", x, mask) @ self.weights["V"][h:]
        o += self.weights["c"]
        o -= o.max(2, keepdims=True)
        o -= np.log(np.exp(o).sum(2, keepdims=True))
        return o

    def chunk_sums(self, buffer: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each chunk the sum of the log probabilities of its letters (chunk, language)."""
        out = np.zeros((len(first), len(self.langs)), np.float32)
        order = np.argsort(end - begin, kind="stable")
        for k in range(0, len(order), SIDE):
            part = order[k : k + SIDE]
            n = (end - begin)[part]
            at = begin[part] + np.arange(int(n.max()))[:, None]
            x = buffer[np.minimum(at, len(buffer) - 1)]
            own = (at >= first[part]) & (at < last[part]) & (x != 32)
            out[part] = np.einsum("tc,tcl->cl", own, self.labels(x, n))
        return out

    def gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        w, mask = self.weights, np.arange(x.shape[0])[:, None] < n
        (hf, tf), (hb, tb) = self._direction("f", x, mask, True), self._direction("b", x, mask, True)
        h = np.concatenate((hf, hb), 2)
        o = h @ w["V"] + w["c"]
        o -= o.max(2, keepdims=True)
        p = np.exp(o)
        p /= p.sum(2, keepdims=True)
        total = mask.sum()
        loss = float(-(np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-9)) * mask).sum() / total)
        p[:, np.arange(len(y)), y] -= 1
        p *= (mask / total)[:, :, None].astype(np.float32)
        g = {"V": np.einsum("twh,twl->hl", h, p), "c": p.sum((0, 1)), "E": np.zeros_like(w["E"])}
        dh, size = p @ w["V"].T, hf.shape[2]
        for d, tape, part in (("f", tf, dh[:, :, :size]), ("b", tb, dh[:, :, size:])):
            u, table, du, back = w[f"U{d}"], np.zeros((256, 3 * size), np.float32), np.zeros_like(w[f"U{d}"]), np.zeros(hf.shape[1:], np.float32)
            for t, state, r, z, s, new in reversed(tape):
                m = mask[t][:, None]
                whole = back + part[t]
                now = np.where(m, whole, 0)
                dn = now * (1 - z) * (1 - new * new)
                ds = dn @ u[:, 2 * size :].T
                dz, dr = now * (state - new) * z * (1 - z), ds * state * r * (1 - r)
                da = np.concatenate((dr, dz, dn), 1)
                du[:, : 2 * size] += state.T @ da[:, : 2 * size]
                du[:, 2 * size :] += s.T @ dn
                np.add.at(table, x[t], da)
                back = np.where(m, now * z + ds * r + da[:, : 2 * size] @ u[:, : 2 * size].T, whole)
            g |= {f"U{d}": du, f"b{d}": table.sum(0), f"W{d}": w["E"].T @ table}
            g["E"] += table @ w[f"W{d}"].T
        return loss, g

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = 300, batch: int = 256, length: int = 40, rate: float = 0.02, seed: int = 1) -> None:
        """Adam over batches of ``length`` bytes from anywhere in the texts, as many of each language."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        buffer, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        starts, total = ends - [len(t) for t in texts], [np.cumsum([len(t) if k == lang else 0 for t, k in zip(texts, y.tolist(), strict=True)]) for lang in range(len(self.langs))]
        for step in range(1, steps + 1):
            lang = rng.integers(0, len(self.langs), batch)
            place = (rng.random(batch) * [total[k][-1] for k in lang]).astype(np.int64)
            doc = np.array([np.searchsorted(total[k], p, side="right") for k, p in zip(lang, place, strict=True)])
            begin = starts[doc] + place - np.array([total[k][d - 1] if d else 0 for k, d in zip(lang, doc, strict=True)])
            begin = aligned(buffer, begin, starts[doc])
            n = np.minimum(length, ends[doc] - begin)
            x = buffer[np.minimum(begin + np.arange(length)[:, None], len(buffer) - 1)]
            _, g = self.gradient(x, n, lang)
            pace = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                self.weights[k] = (self.weights[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


class Scorer:
    """Document probabilities."""

    def __init__(self, network: Network):
        self.network = network

    def documents(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.network.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        flat = [letters_of(t) for t in texts]
        buffer, ends = np.frombuffer(b"".join(flat), np.uint8), np.cumsum([len(f) for f in flat])
        sums = np.zeros((len(texts), len(self.network.langs)))
        if len(buffer):
            doc, *spans = chunked(buffer, ends - [len(f) for f in flat], ends)
            np.add.at(sums, doc, self.network.chunk_sums(buffer, *spans))
        out = []
        for text, own, total in zip(texts, flat, sums, strict=True):
            if not (own and has_letter(text)):
                out.append((UNKNOWN, 0.0))
                continue
            mean = total / (len(own) - own.count(b" "))
            p = np.exp(mean - mean.max())
            p /= p.sum()
            out.append((self.network.langs[int(p.argmax())], float(p.max())))
        return out


def train(docs: DataFrame, allowed: Column, sample: int = 250, steps: int = 300, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """A network from text and lang of the rows where ``allowed`` holds; rows with a null id, text or lang don't count.

    Of each language ``sample`` rows take part, those with the smallest hash of doc_id, with their whole texts.
    Languages weigh the same. Without any row, a network without languages, which answers ``und``.
    """
    rows = docs.where(allowed & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    drawn = rows.select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("id", "lang").distinct()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array([letters_of(r) for r in raw_texts(batch.column("text"))], pa.binary())], names=["id", "lang", "letters"])

    # Rows that repeat an id in one language count once, so that no more than the sample comes to the driver.
    once = rows.join(F.broadcast(drawn), ["id", "lang"]).mapInArrow(extract, "id long, lang string, letters binary").groupBy("id", "lang").agg(F.min("letters").alias("letters"))
    got = sorted((r.id, r.lang, bytes(r.letters)) for r in once.collect())
    langs = sorted({lang for _, lang, letters in got if letters})
    network = Network.new(langs)
    if len(langs) > 1:
        used = [(letters, langs.index(lang)) for _, lang, letters in got if letters]
        network.train([t for t, _ in used], np.array([k for _, k in used]), steps)
    return network


def identify(docs: DataFrame, network: Network, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with their language and its probability.

    ``und`` with score 0 where the text is null or empty or has no letter. Present columns of these
    names are replaced. Every row comes back in its partition; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = extended(docs.schema, (pred, T.StringType()), (score, T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                found = scorer.documents(raw_texts(batch.column(text)))
                columns = with_columns(batch, {pred: pa.array([f[0] for f in found], pa.string()), score: pa.array([f[1] for f in found], pa.float64())})
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])
        release()

    return docs.mapInArrow(run, schema)
