"""Substring dedup over a log-structured index of window fingerprints.

Every run of ``window`` consecutive words has a 64-bit key and a 16-bit check, and counts as
repeated only where both agree. Documents are taken in batches of ascending doc_id, and a batch
in blocks of about ``block_bytes`` of text. For each batch:

* a block sorts its windows' keys and checks and keeps each pair once, at its first document;
* keys are dealt by range to buckets, as sorted byte payloads of a few bytes a key;
* a bucket merges the batch's payloads with the runs written by earlier batches. A key
  that a run or an earlier block holds, with the same check (the verification), is a
  repeat; a bit for each key goes back to the block;
* keys that are new become the batch's own run: immutable, sorted, in the shared folder;
* when ``fanout`` runs of a level have gathered they are compacted into one of the next.

An index with a path stays: later calls, in other sessions too, take its runs as documents that
came before theirs, and add their own. Without one the runs are removed at the end.

At the end each block is read again with its bits and drops the covered words. Only key
payloads and one bit a key travel beside the texts; no group grows with a popular passage,
since a block sends each key once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bucket_bounds, drop_scratch, exists, extended, from_planes, mixed, pack_sorted, planes, raw_texts, released, total_bytes, unpack_sorted, word_hashes, write_scratch

HISTORY = -1
STEP, STEP2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
PAYLOAD = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary())])
PAYLOAD_SQL = "kind int, block long, bucket long, keys binary, checks binary"
RUN, REPLY = 0, 1
STATE = "buckets int, window int, fanout int, level int, run string"


def ranked(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by key and check, and where in it a new pair begins."""
    by = np.argsort(key, kind="stable")
    again = key[by][1:] == key[by][:-1]
    if (again & (check[by][1:] != check[by][:-1])).any():  # keys that collide: the checks decide
        by = np.lexsort((check, key))
        again = (key[by][1:] == key[by][:-1]) & (check[by][1:] == check[by][:-1])
    return by, np.concatenate((np.ones(min(1, len(key)), bool), ~again))


class Block:
    """The windows of one block's documents, in order of doc_id."""

    def __init__(self, table: pa.Table, doc_id: str, text: str, window: int):
        ids = table.column(doc_id).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        raw = raw_texts(table.column(text))
        self.texts = [raw[i] for i in self.order]
        hashes = [word_hashes(t.split()) for t in self.texts]
        self.sizes = np.fromiter(map(len, hashes), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.window, ids = window, ids[self.order]
        n = int(self.sizes.sum())
        h = np.concatenate(hashes) if n else np.empty(0, U64)
        del hashes
        m = max(0, n - window + 1)
        key, check, h2 = np.zeros(m, U64), np.zeros(m, U64), mixed(h)
        for k in range(window):
            key = key * STEP + h[k : k + m]
            check = check * STEP2 + h2[k : k + m]
        row = np.repeat(np.arange(len(ids)), self.sizes)
        inside = row[:m] == row[window - 1 :] if m else np.empty(0, bool)
        self.at = np.flatnonzero(inside)
        key, check = mixed(key[self.at]), (check[self.at] >> U64(48)).astype(np.uint16)
        by, lead = ranked(key, check)
        first = by[lead]
        self.keys, self.checks, self.of = key[first], check[first], np.empty(len(key), np.int64)
        self.of[by] = np.cumsum(lead) - 1
        owner = ids[row[self.at]] if m else ids[:0]
        # A repeat inside the block: the window stands first in a document of a smaller id.
        self.repeat = owner > owner[first][self.of]

    def payloads(self, block: int, buckets: int) -> pa.Table:
        b = bucket_bounds(self.keys, buckets)
        full = np.flatnonzero(np.diff(b))
        return pa.table({"kind": pa.array([REPLY] * len(full), pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()), "keys": pa.array([pack_sorted(self.keys[b[i] : b[i + 1]]) for i in full], pa.binary()), "checks": pa.array([planes(self.checks[b[i] : b[i + 1]]) for i in full], pa.binary())}, schema=PAYLOAD)

    def covered(self, known: np.ndarray) -> np.ndarray:
        """Which words a removed window covers; ``known``: a flag for each key."""
        hit = self.at[self.repeat | known[self.of]] if len(self.keys) else self.at
        edge = np.zeros(int(self.sizes.sum()) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def merge_bucket(table: pa.Table, unordered: int) -> pa.Table:
    """One bucket's payloads and runs: a reply for each block, and the run of new keys.

    Blocks from number ``unordered`` on hold documents without an id, which don't judge each other.
    """
    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    table = table.take(order)
    blocks, bucket = table.column("block").to_numpy(), table.column("bucket")[0].as_py()
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    checks = np.concatenate([from_planes(x, np.uint16) for x in table.column("checks").to_pylist()])
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    key = np.concatenate(keys)
    by, lead = ranked(key, checks)
    start = np.flatnonzero(lead)
    head = np.repeat(by[start], np.diff(np.append(start, len(by))))
    late = np.repeat(blocks >= unordered, sizes)
    repeat = np.zeros(len(key), bool)
    repeat[by] = (by != head) & ~(late[by] & late[head])
    ends = np.cumsum(sizes)
    out: dict[str, list] = {n: [] for n in PAYLOAD.names}
    for block, a, b in zip(blocks.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        if block != HISTORY:
            for name, value in zip(PAYLOAD.names, (REPLY, block, bucket, np.packbits(repeat[a:b]).tobytes(), b"%d" % (b - a)), strict=True):
                out[name].append(value)
    own = by[start]
    own = own[own >= sizes[blocks == HISTORY].sum()]
    for name, value in zip(PAYLOAD.names, (RUN, HISTORY, bucket, pack_sorted(key[own]), planes(checks[own])), strict=True):
        out[name].append(value)
    return pa.table(out, schema=PAYLOAD)


def compact_bucket(table: pa.Table) -> pa.Table:
    """One bucket of several runs as one run; runs share no window."""
    key = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
    checks = np.concatenate([from_planes(x, np.uint16) for x in table.column("checks").to_pylist()])
    by, _ = ranked(key, checks)
    return pa.table({"kind": [RUN], "block": [HISTORY], "bucket": [table.column("bucket")[0].as_py()], "keys": [pack_sorted(key[by])], "checks": [planes(checks[by])]}, schema=PAYLOAD)


def _payloads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stored payloads; a path that a write without rows has not made counts as empty."""
    schema = "block long, bucket long, keys binary, checks binary"
    there = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


class WindowIndex:
    """The index: immutable runs, each a table (bucket, keys, checks), in levels.

    With ``path`` (a folder that the cluster shares) the list of runs is written there after each
    change, as a numbered table: the last complete one counts, so a call that dies leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, buckets: int, window: int = 13, fanout: int = 4, path: str | None = None):
        self.spark, self.buckets, self.window, self.fanout, self.path = spark, buckets, window, fanout, path
        self.runs: list[tuple[int, str]] = []
        self.compactions = self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 256, window: int = 13, fanout: int = 4) -> WindowIndex:
        """The index at a path with the settings that it was made with, or a new one with these."""
        index = cls(spark, buckets, window, fanout, path)
        while exists(spark, f"{path}/state-{index.version + 1}/_SUCCESS"):
            index.version += 1
        if index.version:
            rows = spark.read.schema(STATE).parquet(f"{path}/state-{index.version}").collect()
            index.buckets, index.window, index.fanout = rows[0].buckets, rows[0].window, rows[0].fanout
            index.runs = sorted((r.level, r.run) for r in rows if r.run)
        return index

    def save(self) -> None:
        if self.path:
            rows = [(self.buckets, self.window, self.fanout, level, run) for level, run in self.runs or [(0, None)]]
            self.spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state-{self.version + 1}")
            self.version += 1

    def _written(self, df: DataFrame) -> str:
        path = write_scratch(df, "run", "kind", self.path)
        return f"{path}/kind={RUN}"

    def add(self, blocks: DataFrame, doc_id: str, text: str, keep: bool = True, unordered: int = 1 << 62) -> str:
        """Merge-joins a batch (a table with a column _lx_block) with every run.

        Returns the path of the replies (see ``replies``). The batch's new keys become a
        run, unless ``keep`` is false.
        """
        buckets, window = self.buckets, self.window

        def windows(key: tuple, table: pa.Table) -> pa.Table:
            return released(Block(table, doc_id, text, window).payloads(key[0].as_py(), buckets))

        every = blocks.select("_lx_block", doc_id, text).groupBy("_lx_block").applyInArrow(windows, PAYLOAD_SQL)
        if self.runs:
            every = every.unionByName(_payloads(self.spark, [run for _, run in self.runs]).withColumn("kind", F.lit(RUN)))
        merged = every.groupBy("bucket").applyInArrow(lambda table: released(merge_bucket(table, unordered)), PAYLOAD_SQL)
        run = self._written(merged if keep else merged.where(F.col("kind") == REPLY))
        if keep:
            self.runs.append((0, run))
        return f"{run.removesuffix(f'/kind={RUN}')}/kind={REPLY}"

    def compact(self) -> None:
        """Merges the runs of a level into one of the next where ``fanout`` have gathered."""
        for level in range(max((k for k, _ in self.runs), default=-1) + 1):
            own = [run for k, run in self.runs if k == level]
            if len(own) >= self.fanout:
                whole = self._written(_payloads(self.spark, own).withColumn("kind", F.lit(RUN)).groupBy("bucket").applyInArrow(lambda table: released(compact_bucket(table)), PAYLOAD_SQL))
                self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, whole)]
                self.compactions += 1
                self.save()
                for run in own:
                    drop_scratch(self.spark, run)

    def clear(self) -> None:
        for _, run in self.runs:
            drop_scratch(self.spark, run)
        self.runs = []


def replies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_lx_block, bucket, bits, n): a bit for each of the block's keys in the bucket, in order."""
    return _payloads(spark, paths).select(F.col("block").alias("_lx_block"), "bucket", F.col("keys").alias("bits"), F.col("checks").cast("string").cast("long").alias("n"))


def _blocks(docs: DataFrame, doc_id: str, text: str, size: int, block_bytes: int, ranges: int = 4096) -> tuple[DataFrame, int]:
    """The rows with _lx_block, ascending with doc_id, and the number of blocks.

    Ranges of ids end at quantiles, up to ``ranges`` of them and several for each block; their
    bytes decide: neighbouring ranges share a block up to ``block_bytes``, a larger range is cut
    evenly by id into as many as it needs. The driver never holds more than a few thousand edges.
    """
    n = max(1, -(-size // block_bytes))
    k = min(4 * n, ranges)
    cuts = docs.agg(F.percentile_approx(doc_id, [i / k for i in range(1, k)] or [0.5], 100 * k)).first()[0] or []
    if not cuts or n == 1:
        return docs.withColumn("_lx_block", F.lit(0).cast("long")), 1
    edges = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    split = Bucketizer(splits=edges, inputCol="_lx_key", outputCol="_lx_range", handleInvalid="keep")
    out = split.transform(docs.withColumn("_lx_key", F.col(doc_id).cast("double"))).withColumn("_lx_range", F.col("_lx_range").cast("int"))
    held = {r["_lx_range"]: r for r in out.groupBy("_lx_range").agg(F.min("_lx_key").alias("low"), F.max("_lx_key").alias("high"), F.sum(F.octet_length(text)).alias("bytes")).collect()}
    low, wide, parts, first, at, filled = [], [], [], [], 0, 0
    for r in range(len(edges) - 1):
        x = held.get(r)
        own = (x.bytes or 0) if x else 0
        low.append(x.low if x else 0.0)
        wide.append((x.high - x.low) if x and x.high > x.low else 1.0)
        parts.append(max(1, -(-own // block_bytes)))
        if filled and filled + own > block_bytes:
            at, filled = at + 1, 0
        first.append(at)
        at, filled = (at + parts[-1], 0) if parts[-1] > 1 else (at, filled + own)
    of = lambda values: F.element_at(F.lit(values), F.col("_lx_range") + 1)
    inside = F.least(F.floor((F.col("_lx_key") - of(low)) / of(wide) * of(parts)), of(parts) - 1)
    return out.withColumn("_lx_block", (of(first) + inside).cast("long")).drop("_lx_key", "_lx_range"), at + 1


def substring_dedup(docs: DataFrame, window: int = 13, batches: int = 2, block_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, doc_id: str = "doc_id", text: str = "text", index: WindowIndex | None = None) -> DataFrame:
    """The rows with their repeated passages removed.

    A word goes if a window that covers it has a word sequence that also starts in a
    document with a smaller doc_id; windows are judged on the input. ``text`` becomes the
    kept words joined by one space; ``n_words`` and ``n_removed`` (long) are set. Words are
    runs outside ASCII white space. A null text has no words and becomes ''. Rows with the
    same doc_id don't judge each other. Rows with a null doc_id come last: they lose what
    any document with an id holds, and take nothing from others. An empty table gives an
    empty result.

    With ``index``, all documents that went into it before count as earlier ones, whatever
    their ids, and these go into it as well; its window counts.
    """
    spark = docs.sparkSession
    size = total_bytes(docs, text)
    schema = extended(docs.schema, (text, T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()))
    names = [f.name for f in schema.fields]
    inner = docs.withColumn("_lx_id", F.col(doc_id).cast("long"))
    named, n = _blocks(inner.where("_lx_id is not null"), "_lx_id", text, size, block_bytes)
    # Rows without an id: dealt by their text to blocks of their own, behind all others.
    nameless = inner.where("_lx_id is null")
    spread = max(1, -(-total_bytes(nameless, text) // block_bytes))
    nameless = nameless.withColumn("_lx_id", F.lit(2**63 - 1)).withColumn("_lx_block", F.lit(n) + F.pmod(F.xxhash64(text), F.lit(spread)))
    blocks = named.unionByName(nameless)
    total = n + spread
    index = index or WindowIndex(spark, max(1, -(-size // bucket_bytes)), window)
    window = index.window
    edges = [*(n * i // batches for i in range(batches)), total]  # what has no id is in one batch, the last
    answers = []
    for a, b in ((a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b):
        part = blocks.where((F.col("_lx_block") >= a) & (F.col("_lx_block") < b))
        answers.append(index.add(part, "_lx_id", text, keep=b < total or index.path is not None, unordered=n))
        index.compact()
    if index.path:
        index.save()
    else:
        index.clear()

    def apply(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(table, "_lx_id", text, window)
        known = np.zeros(len(block.keys), bool)
        at = 0
        for i in np.argsort(bits.column("bucket").to_numpy()):
            m = bits.column("n")[int(i)].as_py()
            known[at : at + m] = np.unpackbits(np.frombuffer(bits.column("bits")[int(i)].as_py(), np.uint8), count=m)
            at += m
        if at != len(known):
            raise ValueError("the index answered for other windows than the block has")
        gone = block.covered(known)
        kept, removed = [], []
        for raw, a, size in zip(block.texts, block.starts.tolist(), block.sizes.tolist(), strict=True):
            own, words = gone[a : a + size], raw.split()
            removed.append(int(own.sum()))
            kept.append(b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g] if removed[-1] else words))
        ordered = table.take(block.order)
        new = {text: pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(block.sizes), "n_removed": pa.array(removed, pa.int64())}
        return pa.table({f: new[f] if f in new else ordered.column(f) for f in names})

    return blocks.groupBy("_lx_block").cogroup(replies(spark, answers).groupBy("_lx_block")).applyInArrow(lambda key, table, bits: released(apply(key, table, bits)), schema)
