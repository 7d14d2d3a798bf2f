"""Language-model scores from a log-frequency Bloom filter.

Counting: every word and every pair of neighbouring words of the training texts is a
64-bit key. Tasks pre-aggregate sorted keys with counts and deal them by key range to
buckets; a bucket adds them up. Word counts stay exact (they give the base score); for the
filter a count c becomes the level 1 + floor(log2 c).

Filter: a key of level q is put in as the q events (key, 1) ... (key, q). A lookup probes
(key, 1), (key, 2), ... until one is missing, so a level is never too low, and too high only
by a false positive. Each bucket has its own segment, sized by its number of events; an event
sets four bits of one 64-bit word.

Scores: P(w | h) = (E(hw) + mu P1(w)) / (E(h) + mu), with E(level) the middle of the level's
counts, E(hw) no more than E(h) and E(w), and P1 the additively smoothed share of w.
A pair whose words weren't both seen has count 0.

The tables are broadcast in shards of at most ``shard_bytes``. If there are more shards, the
texts go through one pass for each, with the levels found so far carried in a column of two
bytes a token, written between passes. The result doesn't depend on the number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bucket_bounds, bucket_of, drop_scratch, from_planes, mixed, pack_sorted, planes, raw_texts, slices, total_bytes, unpack_sorted, word_hashes, write_scratch

# Keys of the two marks; neither can be a word, which holds no white space.
END, START = U64(xxhash.xxh3_64_intdigest(b"\n")), U64(xxhash.xxh3_64_intdigest(b" "))
PAIR, LEVEL = U64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03
FLUSH = 3_000_000


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of all texts in a row, each text closed by END, and the number of tokens of each."""
    per = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, per), np.int64, len(per)) + 1
    ends = np.cumsum(sizes) - 1
    out = np.full(int(sizes.sum()), END, U64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = word_hashes([w for ws in per for w in ws])
    return out, sizes


def pairs_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each token with the token before it (START for the first)."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return mixed(before * PAIR + tokens)


# ---------------------------------------------------------------- counting


def _dealt(kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> dict[str, list]:
    b = bucket_bounds(keys, buckets)
    full = np.flatnonzero(np.diff(b))
    return {"kind": [kind] * len(full), "bucket": full.tolist(), "keys": [pack_sorted(keys[b[i] : b[i + 1]]) for i in full], "counts": [planes(counts[b[i] : b[i + 1]].astype(np.uint32)) for i in full]}


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, U64), np.empty(0, np.int64)
    key = np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    key, count = key[by], np.concatenate(counts)[by].astype(np.int64)
    lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[lead], np.add.reduceat(count, lead) if len(lead) else count


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def middle(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    top = np.exp2(levels.astype(np.float64))
    return np.where(levels > 0, (top / 2 + top - 1) / 2, 0.0)


COUNTED = "bucket long, words binary, word_counts binary, levels binary, pairs binary, pair_levels binary, n_words long, n_tokens long, n_events long"


def count(texts: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket of the key space with its words, exact counts, pairs and levels."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                if parts:
                    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_pydict(_dealt(kind, keys, counts, buckets), schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))
                parts.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, sizes = tokens_of(raw_texts(batch.column("text")))
                held[0].append(tokens)
                held[1].append(pairs_of(tokens, sizes))
                if sum(map(len, held[0])) >= FLUSH:
                    yield from flush()
        yield from flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts: list[tuple[list, list]] = [([], []), ([], [])]
        for kind, keys, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
            parts[kind][0].append(unpack_sorted(keys))
            parts[kind][1].append(from_planes(counts, np.uint32))
        (words, counts), (pairs, pair_counts) = (_summed(*p) for p in parts)
        levels, pair_levels = quantised(counts), quantised(pair_counts)
        row = key[0].as_py(), pack_sorted(words), counts.tobytes(), levels.tobytes(), pack_sorted(pairs), pair_levels.tobytes(), len(words), int(counts.sum()), int(levels.sum(dtype=np.int64) + pair_levels.sum(dtype=np.int64))
        return pa.table({n.split()[0]: [v] for n, v in zip(COUNTED.split(", "), row, strict=True)})

    return texts.mapInArrow(gather, "kind int, bucket long, keys binary, counts binary").groupBy("bucket").applyInArrow(merge, COUNTED)


# ---------------------------------------------------------------- the filter


def _events(keys: np.ndarray, level: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Each event's word within its segment of ``size`` words, and its four bits."""
    e = mixed(keys + U64(LEVEL * level % (1 << 64)))
    one = U64(1)
    bits = one << (e & U64(63)) | one << ((e >> U64(6)) & U64(63)) | one << ((e >> U64(12)) & U64(63)) | one << ((e >> U64(18)) & U64(63))
    return ((e >> U64(32)) * (size if isinstance(size, np.ndarray) else U64(size))) >> U64(32), bits


def segment(keys: np.ndarray, levels: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, U64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, bits = _events(keys[levels >= level], level, size)
        np.bitwise_or.at(out, at.astype(np.int64), bits)
    return out


@dataclass
class Shard:
    """Buckets first..last-1 of the model: exact word counts, and the filter's segments."""

    buckets: int
    first: int
    last: int
    words: np.ndarray
    counts: np.ndarray
    filter: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def own(self, keys: np.ndarray) -> np.ndarray:
        b = bucket_of(keys, self.buckets)
        return np.flatnonzero((b >= U64(self.first)) & (b < U64(self.last)))

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at], 0)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which all events of each key are in the filter."""
        out, rest = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        b = (bucket_of(keys, self.buckets) - U64(self.first)).astype(np.int64)
        starts, sizes = self.starts[b], self.sizes[b]
        rest = rest[sizes > 0]
        for level in range(1, 64):
            at, bits = _events(keys[rest], level, sizes[rest])
            rest = rest[self.filter[starts[rest] + at.astype(np.int64)] & bits == bits]
            if not len(rest):
                break
            out[rest] = level
        return out


@dataclass
class Model:
    """The counted table and its totals; ``shards`` yields what is broadcast."""

    table: DataFrame
    buckets: int
    tokens: int
    words: int
    bits: int
    bounds: list[tuple[int, int]]

    def shard(self, first: int, last: int) -> Shard:
        bits = self.bits

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    words, pairs = unpack_sorted(r["words"]), unpack_sorted(r["pairs"])
                    seg = segment(np.concatenate((words, pairs)), np.frombuffer(r["levels"] + r["pair_levels"], np.uint8), max(1, -(-r["n_events"] * bits // 64)))
                    counts = np.frombuffer(r["word_counts"], np.int64)
                    yield pa.RecordBatch.from_pydict({"bucket": [r["bucket"]], "words": [words.tobytes()], "counts": [counts.tobytes()], "segment": [seg.tobytes()]}, schema=pa.schema([("bucket", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("segment", pa.binary())]))

        own = self.table.where((F.col("bucket") >= first) & (F.col("bucket") < last))
        # At most shard_bytes in all; the table's rows arrive one partition at a time.
        got = {r.bucket: r for r in own.mapInArrow(build, "bucket long, words binary, counts binary, segment binary").toLocalIterator()}
        part = lambda name, kind: [np.frombuffer(getattr(got[b], name), kind) if b in got else np.empty(0, kind) for b in range(first, last)]
        words, counts, filters = part("words", U64), part("counts", np.int64), part("segment", U64)
        del got
        sizes = np.array([len(x) for x in filters], U64)
        join = lambda x: np.concatenate(x) if x else np.empty(0)
        return Shard(self.buckets, first, last, join(words), join(counts), join(filters), (np.cumsum(sizes) - sizes).astype(np.int64), sizes)


def train(docs: DataFrame, allowed: Column, bits: int = 9, shard_bytes: int = 96 << 20, bucket_bytes: int = 8 << 20, text: str = "text") -> Model:
    """Counts words and pairs of the texts where ``allowed`` holds; a null text is an empty one, with only its end."""
    texts = docs.where(allowed).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    buckets = min(1 << 20, max(1, -(-total_bytes(texts) // bucket_bytes)))
    table = docs.sparkSession.read.parquet(write_scratch(count(texts, buckets), "lm"))
    stats = {r.bucket: r for r in table.select("bucket", "n_words", "n_tokens", "n_events").collect()}
    bounds, first, held = [], 0, 0
    for b in range(buckets):
        size = 16 * stats[b].n_words + stats[b].n_events * bits // 8 + 8 if b in stats else 0
        if held and held + size > shard_bytes:
            bounds.append((first, b))
            first, held = b, 0
        held += size
    bounds.append((first, buckets))
    return Model(table, buckets, sum(r.n_tokens for r in stats.values()), sum(r.n_words for r in stats.values()), bits, bounds)


# ---------------------------------------------------------------- scoring


def conditional(word: np.ndarray, before: np.ndarray, pair: np.ndarray, tokens: int, words: int, mu: float) -> np.ndarray:
    """P(w | h) from the levels of w, h and hw."""
    e, eh = middle(word), middle(before)
    p1 = (e + 0.1) / (tokens + 0.1 * (words + 1))
    both = np.where((word > 0) & (before > 0), np.minimum(np.minimum(middle(pair), e), eh), 0.0)
    return (both + mu * p1) / (eh + mu)


def score(docs: DataFrame, model: Model, mu: float = 16.0, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the columns ``keep``, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words (runs outside ASCII white space, A-Z lower-cased) and one end for each
    text; a null text counts as empty. n_known counts tokens with c > 0, c being the exact
    count in training. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))), score sums
    log10 P(w | h). Repeated rows come back each; without training tokens (N = V = 0) all
    tokens are unknown and have probability 1 in both. A kept column that is named like one of the
    others gives way to it.
    """
    spark = docs.sparkSession
    outputs = {"n_tokens", "n_known", "train_tokens", "base_score", "score", doc_id.lower()}
    keep = [k for k in keep or [] if k.lower() not in outputs]
    state = docs.select(doc_id, *keep, F.col(text).cast("string").alias("_lx_text"), F.lit(None).cast("binary").alias("_lx_levels"), F.lit(0.0).alias("_lx_base"), F.lit(0).cast("long").alias("_lx_known"))
    result = f"{doc_id} {dict(docs.dtypes)[doc_id]}" + "".join(f", `{k}` {dict(docs.dtypes)[k]}" for k in keep) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"
    total, vocabulary, path = model.tokens, model.words, None
    for number, (first, last) in enumerate(model.bounds):
        shared = spark.sparkContext.broadcast(model.shard(first, last))
        final = number + 1 == len(model.bounds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, final=final) -> Iterator[pa.RecordBatch]:
            shard = shared.value
            floor = total + 0.1 * (vocabulary + 1)
            for whole in batches:
                for batch in slices(whole, "_lx_text", 4 << 20):
                    tokens, sizes = tokens_of(raw_texts(batch.column("_lx_text")))
                    ends = np.cumsum(sizes)
                    starts = ends - sizes
                    carried = batch.column("_lx_levels").to_pylist()
                    levels = np.zeros((2, len(tokens)), np.uint8)
                    for a, b, x in zip(starts.tolist(), ends.tolist(), carried, strict=True):
                        if x is not None:
                            levels[:, a:b] = np.frombuffer(x, np.uint8).reshape(2, -1)
                    kinds, of = np.unique(tokens, return_inverse=True)
                    own = shard.own(kinds)
                    exact, found, logs = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.uint8), np.zeros(len(kinds))
                    exact[own] = shard.exact(kinds[own])
                    found[own] = shard.levels(kinds[own])
                    logs[own] = np.log10((exact[own] + 0.1) / floor)
                    levels[0] = np.maximum(levels[0], found[of])
                    pairs = pairs_of(tokens, sizes)
                    own = shard.own(pairs)
                    levels[1, own] = shard.levels(pairs[own])
                    base = batch.column("_lx_base").to_numpy() + np.add.reduceat(logs[of], starts)
                    known = batch.column("_lx_known").to_numpy() + np.add.reduceat((exact > 0)[of].astype(np.int64), starts)
                    ids = [batch.column(i) for i in range(1 + len(keep))]
                    if not final:
                        packed = pa.array([levels[:, a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays([*ids, batch.column("_lx_text"), packed, pa.array(base), pa.array(known)], names=batch.schema.names)
                        continue
                    # A text's first token follows START, which stands as often as the end, its last token.
                    before = np.empty_like(levels[0])
                    before[1:] = levels[0, :-1]
                    before[starts] = levels[0, ends - 1]
                    p = conditional(levels[0], before, levels[1], total, vocabulary, mu)
                    columns = [*ids, pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), starts))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: 1 + len(keep)], "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        if final:
            return state.mapInArrow(run, result)
        old, path = path, write_scratch(state.mapInArrow(run, state.schema), "levels")
        state = spark.read.parquet(path)
        shared.destroy()
        if old:
            drop_scratch(spark, old)
    raise AssertionError("a model has at least one shard")
