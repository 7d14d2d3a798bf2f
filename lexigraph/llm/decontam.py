"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case,
   so case, punctuation and spacing don't matter.
2. One pass over the corpus counts, for every n-gram of the test items, the documents that
   hold it. In each stretch of ``span`` consecutive n-grams of an item the rarest one
   becomes a seed. Any copy that keeps ``span + n - 1`` consecutive words intact holds a
   seed, and so does any copy that keeps the rarest n-gram of some stretch.
3. A second pass joins the documents to the items over the seeds: a seed at word p of a
   document and word q of an item starts an alignment of the item with the words around
   p - q. The score is the best local alignment (match 2, mismatch -1, gap -1 a word) as a
   share of the item's highest possible score. A document holds an item if the score reaches
   the threshold, or if the alignment is worth ``passage`` words copied in a row: a part of a
   long item counts as well.

Items are taken in blocks of bounded size, each broadcast on its own; the corpus is never
shuffled or collected, and every hit of every document is aligned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts

#: Bytes to word characters: A-Z lower-cased, every other ASCII byte but letters and digits a blank.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MATCH, MISMATCH, GAP = 2, -1, 1
ITEM_BYTES = 8 << 20


def words_of(raw: bytes) -> list[bytes]:
    return (raw if raw.isascii() else raw.decode().lower().encode()).translate(TO_WORDS).split()


class Items:
    """A block of test items: word ids, n-grams and, once chosen, seeds."""

    def __init__(self, rows: list[tuple[int, bytes]], n: int):
        self.ids = [i for i, _ in rows]
        texts = [words_of(t) for _, t in rows]
        self.vocab: dict[bytes, int] = {}
        for ws in texts:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.words = [np.array([self.vocab[w] for w in ws], np.int64) for ws in texts]
        self.sizes = [min(n, len(w)) for w in self.words]
        self.n = n
        self.grams: dict[bytes, int] = {}
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for w, size in zip(self.words, self.sizes, strict=True):
            for q in range(len(w) - size + 1 if size else 0):
                self.grams.setdefault(w[q : q + size].tobytes(), len(self.grams))
        self.lengths = sorted({s for s in self.sizes if s})

    def positions(self, words: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Where n-grams made of the items' words stand in a document."""
        for size in self.lengths:
            known = np.convolve(words > 0, np.ones(size, np.int64), "valid") == size if len(words) >= size else np.empty(0, bool)
            for p in np.flatnonzero(known).tolist():
                yield p, words[p : p + size].tobytes()

    def choose(self, counts: dict[int, int], span: int) -> None:
        for k, (w, size) in enumerate(zip(self.words, self.sizes, strict=True)):
            total = len(w) - size + 1 if size else 0
            keys = [w[q : q + size].tobytes() for q in range(total)]
            rank = [(counts.get(self.grams[g], 0), q) for q, g in enumerate(keys)]
            for q in sorted({min(rank[a : a + span])[1] for a in range(max(1, total - span + 1))} if total else ()):
                self.seeds.setdefault(keys[q], []).append((k, q))


def align(item: np.ndarray, words: np.ndarray) -> int:
    """The highest local alignment score of two word sequences (Smith-Waterman, by rows)."""
    slope = np.arange(len(words) + 1, dtype=np.int64) * GAP
    row = np.zeros(len(words) + 1, np.int64)
    best = 0
    for w in item.tolist():
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        np.maximum(new, row - GAP, out=new)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        best = max(best, int(row.max()))
    return best


def stretches(hits: list[tuple[int, int]], length: int, total: int) -> list[tuple[int, int]]:
    """The document's stretches to align an item of ``length`` words with; overlapping ones joined."""
    slack = length // 2 + 4
    spans = sorted((max(0, p - q - slack), min(total, p - q + length + slack)) for p, q in hits)
    out = [spans[0]]
    for a, b in spans[1:]:
        if a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def match(items: Items, raw: bytes, threshold: float, passage: int) -> list[tuple[int, float, int, int]]:
    """(item_id, score, first word, end word) of each item that the text holds."""
    words = np.fromiter(map(items.vocab.get, ws := words_of(raw), repeat(0)), np.int64, len(ws))
    hits: dict[int, list[tuple[int, int]]] = {}
    for p, gram in items.positions(words):
        for k, q in items.seeds.get(gram, ()):
            hits.setdefault(k, []).append((p, q))
    out = []
    for k, at in hits.items():
        item = items.words[k]
        found = max((align(item, words[a:b]) / (MATCH * len(item)), -a, -b) for a, b in stretches(at, len(item), len(words)))
        if found[0] >= min(threshold, passage / len(item)):
            out.append((items.ids[k], found[0], -found[1], -found[2]))
    return out


def seeded_items(docs: DataFrame, benchmark: DataFrame, n: int, span: int, text: str, item_id: str, item_text: str) -> list:
    """Broadcasts of item blocks with their seeds; each block takes one counting pass over the corpus."""
    sources = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = sources.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    texts, sc, out = docs.select(F.col(text).cast("string").alias("text")), docs.sparkSession.sparkContext, []
    for b in range(blocks):
        own = sources.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        items = Items(sorted({(r.i, r.t.encode()) for r in own.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1])), n)
        shared = sc.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, total = shared.value, Counter()
            for batch in batches:
                for raw in raw_texts(batch.column("text")):
                    words = np.fromiter(map(items.vocab.get, ws := words_of(raw), repeat(0)), np.int64, len(ws))
                    total.update({g for _, x in items.positions(words) if (g := items.grams.get(x)) is not None})
            yield pa.RecordBatch.from_pydict({"gram": pa.array(total.keys(), pa.int64()), "c": pa.array(total.values(), pa.int64())})

        # One count for each n-gram of the block: as many as the block has words.
        items.choose(dict(map(tuple, texts.mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c")).collect())), span)
        out.append(sc.broadcast(items))
        shared.unpersist()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, span: int = 4, threshold: float = 0.5, passage: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): items that documents hold, whole or edited.

    One row for each row of ``docs`` and item that it holds by ``threshold`` or ``passage`` (see
    above), with the score from 0 to 1; the words
    are those of the aligned stretch of the document. A null or empty text holds nothing, a
    null item or one without words is held nowhere, and null ids are carried along. Items
    shorter than ``n`` words are sought as one whole gram: a one-word item is held by every text with that word. Repeated rows come back each;
    items that repeat an id and text count once. Empty tables give an empty result.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    out = None
    for seeded in seeded_items(docs, benchmark, n, span, text, item_id, item_text):

        def search(batches: Iterator[pa.RecordBatch], seeded=seeded) -> Iterator[pa.RecordBatch]:
            items = seeded.value
            for batch in batches:
                rows = [(d, *m) for d, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True) for m in match(items, raw, threshold, passage)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(kind)], schema=kind)

        found = texts.mapInArrow(search, "doc_id long, item_id long, score double, first_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 3, span: int = 4, threshold: float = 0.5, passage: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item (see ``contamination``), in their partitions; nothing is shuffled.

    Rows with a null or empty text hold nothing and stay; repeated rows stay or go alike, and ids play no part. Null
    and wordless items are held nowhere; a one-word item is held by every text with that word. Empty tables are fine.
    """
    for seeded in seeded_items(docs, benchmark, n, span, text, item_id, item_text):

        def clean(batches: Iterator[pa.RecordBatch], seeded=seeded) -> Iterator[pa.RecordBatch]:
            items = seeded.value
            for batch in batches:
                yield batch.filter(pa.array([not match(items, raw, threshold, passage) for raw in raw_texts(batch.column(text))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
