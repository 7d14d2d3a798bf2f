"""SimHash near-duplicates: fingerprints searched through vantage-point trees.

Two fingerprints link when they differ in at most ``radius`` bits. The pairs are found
exactly, in three steps:

1. Sharding. The Hamming distance restricted to a mask of bits is a pseudo-metric, so a
   vantage-point tree can be built over it. A pair within ``radius`` spreads its differing
   bits over ``bands`` bands; for some mask of the family the pair is within a small masked
   radius r (0 once bands > radius). One tree per mask routes every fingerprint to its own
   leaf and, when r > 0, a copy to each leaf that the triangle bound can't exclude
   (|d(x, v) - cut| <= r): these are the boundary-overlapping shards. With r = 0 no
   fingerprint is copied across a boundary, which keeps the shuffled rows at one per mask.
2. Hot shards. A leaf with more than ``block`` fingerprints is cut into blocks, and every
   pair of blocks becomes a shard of its own; nothing is dropped and no task holds a leaf.
3. In a shard, rows are ordered by their distance to a vantage point. Only rows whose
   distances differ by at most ``radius`` are compared (triangle bound on the full metric).

Equal fingerprints are collapsed before the search. A shard emits a spanning set of links
(at most one per row), never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bucket_bounds, drop_scratch, from_planes, mixed, pack_sorted, planes, raw_texts, release, slices, unpack_sorted, write_scratch
from .components import components

BITS = 64
LANES = U64(0x0101010101010101)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(words: list[bytes], size: int, seed: int) -> list[int]:
    """XXH64 of each run of ``size`` words joined by one space; of the whole sequence if shorter."""
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    return [h(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``sizes[i]`` hashes: the bits set in over half of them.

    Eight bits are counted at a time in the eight byte lanes of a uint64, in chunks of at
    most 255 hashes so that no lane overflows.
    """
    out = np.zeros(len(sizes), U64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    chunks = -(-n // 255)
    first = np.cumsum(chunks) - chunks
    within = np.arange(chunks.sum()) - np.repeat(first, chunks)
    bounds = np.repeat(np.cumsum(n) - n, chunks) + within * 255
    value = np.zeros(len(full), U64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> U64(k)) & LANES, bounds)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for lane in range(8):
            value |= (2 * counts[:, lane] > n).astype(U64) << U64(8 * lane + k)
    out[full] = value
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, fp) of every row: the fingerprint's 64 bits as a signed long; with ``sets`` also sig and n.

    sig names the set of shingles and n is its size (null and 0 without words). A-Z are lower-cased; words are runs
    outside ASCII white space. A text without words (null, empty, blank) has fingerprint 0.
    """
    names = ["doc_id", "fp", "sig", "n"][: 4 if sets else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                per = [shingle_hashes(r.lower().split(), shingle, seed) for r in raw_texts(batch.column(text))]
                sizes = np.fromiter(map(len, per), np.int64, len(per))
                flat = np.fromiter((h for hs in per for h in hs), U64, int(sizes.sum()))
                columns = [batch.column(doc_id), pa.array(majority(flat, sizes).view(np.int64))]
                if sets:
                    distinct = [np.unique(np.array(hs, U64)) for hs in per]
                    columns += [pa.array(map(signature, distinct), pa.int64()), pa.array(map(len, distinct), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text)).mapInArrow(run, ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- vantage-point trees


def masks(bands: int, radius: int) -> list[tuple[int, int]]:
    """(mask, masked radius) pairs such that words within ``radius`` bits are within some masked radius.

    With more bands than ``radius``, at least bands - radius bands are equal: the masks are
    all unions of that many bands, with radius 0. With fewer, one band differs in at most
    radius // bands bits.
    """
    edges = [BITS * i // bands for i in range(bands + 1)]
    band = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    if bands <= radius:
        return [(m, radius // bands) for m in band]
    return [(sum(c), 0) for c in combinations(band, bands - radius)]


def bands_for(depth: int, radius: int) -> int:
    """The fewest bands whose masks have as many bits as the trees have levels: leaves then stay small as the rows grow."""
    return next(b for b in range(radius + 1, BITS) if BITS * (b - radius) // b >= min(depth, BITS // 2))


class Tree:
    """A vantage-point tree of fixed depth over a masked Hamming distance.

    A node's vantage point follows from its number. Cuts are the medians of a bounded sample, down to ``SAMPLED``
    levels, and half the mask's bits below; they only balance the leaves and never change which pairs are found.
    """

    SAMPLED = 12

    def __init__(self, mask: int, radius: int, depth: int, sample: np.ndarray, salt: int):
        self.mask, self.radius, self.depth, self.salt = U64(mask), radius, depth, U64(salt * 0x9E3779B9 + 1)
        self.cuts = np.full(1 << min(depth, self.SAMPLED), bin(mask).count("1") // 2, np.int64)
        at = np.ones(len(sample), np.int64)
        for _ in range(min(depth, self.SAMPLED)):
            d = self._distance(sample, at)
            for node in np.unique(at):
                own = d[at == node]
                if len(own) >= 8:
                    self.cuts[node] = int(np.median(own))
            at = 2 * at + (d > self.cuts[at])

    def _cut(self, at: np.ndarray) -> np.ndarray:
        return self.cuts[np.where(at < len(self.cuts), at, 0)]

    def _distance(self, fps: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bitwise_count((fps ^ mixed(at.astype(U64) + self.salt)) & self.mask).astype(np.int64)

    def home(self, fps: np.ndarray) -> np.ndarray:
        at = np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (self._distance(fps, at) > self._cut(at))
        return at

    def reach(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold a row within the masked radius."""
        row, at = np.arange(len(fps)), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            d, cut = self._distance(fps[row], at), self._cut(at)
            low, high = d - self.radius <= cut, d + self.radius > cut
            row = np.concatenate((row[low], row[high]))
            at = np.concatenate((2 * at[low], 2 * at[high] + 1))
        return row, at


def shard_pairs(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right) within ``radius``, by blocks of a triangle-bounded scan."""
    point = mixed(np.array([7], U64))[0]
    d = np.bitwise_count(fps ^ point)
    left, right = left[np.argsort(d[left], kind="stable")], right[np.argsort(d[right], kind="stable")]
    dl, dr = d[left].astype(np.int64), d[right].astype(np.int64)
    for value in np.unique(dl):
        rows = left[np.searchsorted(dl, value) : np.searchsorted(dl, value, side="right")]
        near = right[np.searchsorted(dr, value - radius) : np.searchsorted(dr, value + radius, side="right")]
        for k in range(0, len(rows), 512):
            part = rows[k : k + 512]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[near][None, :]) <= radius)
            yield part[i], near[j]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n rows reaches over the pairs (union-find)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        differ = i != j
        for a, b in zip(i[differ].tolist(), j[differ].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], np.int64)


def links(points: DataFrame, radius: int = 4, bands: int | None = None, leaf: int = 256, block: int = 4096, sample: int = 4096) -> DataFrame:
    """(a, b) links that span every group of fingerprints within ``radius`` bits of each other.

    ``points``: (fp, rep), distinct fingerprints with a long to name each. Two reps are in
    one component of the links exactly if a chain of fingerprints within ``radius`` joins them.
    """
    spark = points.sparkSession
    n = points.count()
    wanted = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    bands = bands or bands_for(wanted, radius)
    rows = points.select("fp").orderBy(F.xxhash64("fp")).limit(sample).collect() if n else []
    drawn = np.array([r[0] for r in rows], np.int64).view(U64)
    trees = [Tree(m, r, min(wanted, bin(m).count("1")), drawn, i) for i, (m, r) in enumerate(masks(bands, radius))]
    shared = spark.sparkContext.broadcast(trees)
    kind = pa.schema([("shard", pa.int64()), ("own", pa.bool_()), ("fp", pa.int64()), ("rep", pa.int64())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
            for i, tree in enumerate(shared.value):
                home = tree.home(fp.view(U64))
                row, at = tree.reach(fp.view(U64)) if tree.radius else (np.empty(0, np.int64),) * 2
                away = at != home[row]
                row, at = row[away], at[away]
                base = np.int64(i) << 40
                own = np.concatenate((np.ones(len(fp), bool), np.zeros(len(row), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((home, at)) + base), pa.array(own), pa.array(np.concatenate((fp, fp[row]))), pa.array(np.concatenate((rep, rep[row])))], schema=kind)

    routed = points.mapInArrow(route, "shard long, own boolean, fp long, rep long")
    sizes = routed.groupBy("shard").count().where(F.col("count") > block)
    # A shard of c rows is cut into g = ceil(c / block) blocks; a row meets its own block and every other one.
    spread = routed.join(sizes.withColumn("g", F.ceil(F.col("count") / block).cast("int")).select("shard", "g"), "shard", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    spread = spread.withColumn("k", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    spread = spread.select("shard", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k", "own", "fp", "rep")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        fp, rep = table.column("fp").to_numpy()[order].view(U64), table.column("rep").to_numpy()[order]
        own, k = table.column("own").to_numpy()[order], table.column("k").to_numpy()[order]
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(own & (k == i)), np.flatnonzero(k == j)
        found = [shard_pairs(fp, left, right, radius)]
        if i != j:
            found.append(shard_pairs(fp, np.flatnonzero(own & (k == j)), np.flatnonzero(k == i), radius))
        root = spanning(len(fp), (p for f in found for p in f))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": rep[moved], "b": rep[root[moved]]})

    return spread.groupBy("shard", "i", "j").applyInArrow(search, "a long, b long")


# ---------------------------------------------------------------- the exact join

SKETCH, FILTER, PARTS = 23, 26, 8  # bits of a hash that name its counter, and its flag; bits that name a part of either


def shingle_set(raw: bytes, shingle: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(raw.lower().split(), shingle, seed), U64))


def signature(hashes: np.ndarray) -> int | None:
    """A signed long that names a shingle set; None for an empty one."""
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), U64).view(np.int64)) if len(hashes) else None


def rising(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte that never falls: themselves below 128, then eight steps for each doubling."""
    return np.where(counts < 128, counts, np.minimum(255, 72 + np.floor(8 * np.log2(np.maximum(counts, 1))))).astype(np.uint8)


def tallied(rows: DataFrame, places: Callable[[pa.RecordBatch], np.ndarray], bits: int, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each of 2^bits places comes, ``finish``ed to bytes in parts on the executors: 8 MB here, at any size."""
    part = bits - PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            at, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64),) * 2
            edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << part)).tolist()
            full = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in full], pa.int32()), pa.array([planes(np.diff(at[a:b], prepend=p << part).astype(np.uint32)) for p, a, b in full], pa.binary()), pa.array([planes(c[a:b].astype(np.uint32)) for _, a, b in full], pa.binary())], names=["part", "at", "c"])

        for batch in batches:
            held.append(places(batch))
            if sum(map(len, held)) > 4_000_000:
                yield from flush()
        yield from flush()
        release()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << part, np.int64)
        for at, c in zip(table.column("at").to_pylist(), table.column("c").to_pylist(), strict=True):
            total[np.cumsum(from_planes(at, np.uint32), dtype=np.int64)] += from_planes(c, np.uint32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "c": [finish(total).tobytes()]})

    size = len(finish(np.zeros(1 << part, np.int64)))
    out = np.zeros(size << PARTS, np.uint8)
    for p, c in rows.mapInArrow(count, "part int, at binary, c binary").groupBy("part").applyInArrow(pack, "part int, c binary").collect():
        out[p * size : (p + 1) * size] = np.frombuffer(c, np.uint8)
    release()
    return out


def shingle_counts(texts: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """About how many rows hold a shingle (``rising``), by the leading bits of its hash."""

    def places(whole: pa.RecordBatch) -> np.ndarray:
        own = [shingle_set(raw, shingle, seed) >> U64(64 - SKETCH) for batch in slices(whole, "text", 4 << 20) for raw in raw_texts(batch.column("text"))]
        return np.concatenate([np.empty(0, U64), *own]).astype(np.int64)

    return tallied(texts.select("text"), places, SKETCH, rising)


def flags(tokens: DataFrame) -> np.ndarray:
    """A bit for the leading bits of each token: what isn't flagged isn't among the tokens."""
    return tallied(tokens.select("token"), lambda b: (b.column("token").to_numpy().view(U64) >> U64(64 - FILTER)).astype(np.int64), FILTER, lambda total: np.packbits(total > 0))


def ordered_prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - need + 1 shingles in the global order (rare ones first, then by hash).

    Two sets of that similarity share ``need`` of the n shingles of either, so one of these.
    """
    n = len(hashes)
    size = n - int(np.ceil(similarity * n - 1e-9)) + 1
    return hashes[np.lexsort((hashes, counts[(hashes >> U64(64 - SKETCH)).astype(np.int64)]))][: min(n, size)]


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the (a, b) pairs of signatures those whose sets have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = (np.frombuffer(h.as_buffer(), U64) for h in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: sets.select(F.col("sig").alias(c), F.col("h").alias("h" + c))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def repeated(rows: DataFrame, buckets: int) -> DataFrame:
    """(token) of the tokens that more than one partition of ``rows``, or one more than once, holds.

    Keys travel sorted, as differences in byte planes, once a partition: a few bytes each, whatever a token's share.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, U64), np.empty(0, np.int64))
            b = bucket_bounds(keys, buckets)
            full = np.flatnonzero(np.diff(b)).tolist()
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([pack_sorted(keys[b[i] : b[i + 1]]) for i in full], pa.binary()), pa.array([np.packbits(c[b[i] : b[i + 1]] > 1).tobytes() for i in full], pa.binary())], names=["bucket", "keys", "again"])

        for batch in batches:
            held.append(batch.column("token").to_numpy().view(U64))
            if sum(map(len, held)) > 4_000_000:
                yield from flush()
        yield from flush()
        release()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        again = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=len(k)) for a, k in zip(table.column("again").to_pylist(), keys, strict=True)])
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        every, again = every[by], again[by].astype(bool)
        again[1:] |= every[1:] == every[:-1]
        return pa.table({"token": np.unique(every[again]).view(np.int64)})

    return rows.select("token").mapInArrow(gather, "bucket long, keys binary, again binary").groupBy("bucket").applyInArrow(merge, "token long")


def similar_links(docs: DataFrame, base: DataFrame, points: DataFrame, edges: DataFrame, similarity: float, shingle: int, seed: int, doc_id: str, text: str) -> DataFrame:
    """``edges`` and (a, b) links with which all texts of that similarity are in one component.

    ``base``: (doc_id, fp, sig, n); ``points``: (fp, rep), the nodes. Exact but for the hash: an
    equi-join over the rare ends of the shingle sets (``ordered_prefix``), at any size.

    1. Each shingle has a hub, of the sets that hold it the one with the fewest rarer shingles: the
       text that others were made from, if it is there. Each set is checked against the hub that most
       of its shingles name: at most one pair a set, which joins a large group without its pairs.
    2. Every pair that shares a shingle and still lies in two components is checked, unless the
       lengths or the places of the shared shingle already rule it out.

    The counts behind the order are those of all rows, summed by the leading bits of a shingle's hash.
    They decide how many pairs are looked at, never which are found.
    """
    spark = docs.sparkSession
    read = spark.read.parquet
    scratch: list[str] = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        scratch.append(write_scratch(df, name))
        return read(scratch[-1])

    held = base.where("doc_id is not null and sig is not null").groupBy("sig", "fp").agg(F.min("doc_id").alias("holder"), F.min("n").alias("n")).join(points.select("fp", "rep"), "fp")
    held = stored(held, "held")
    nodes = stored(held.groupBy("sig").agg(F.min("rep").alias("node"), F.min("holder").alias("holder"), F.sum("n").alias("n")), "sets")
    edges = edges.unionByName(held.join(nodes.select("sig", "node"), "sig").where("rep <> node").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    edges = stored(edges, "edges")
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n_shingles = nodes.agg(F.sum("n")).first()[0]
    shared = spark.sparkContext.broadcast(shingle_counts(texts, shingle, seed))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                token, sig, n, pos = [], [], [], []
                for raw in raw_texts(batch.column("text")):
                    hashes = shingle_set(raw, shingle, seed)
                    name = signature(hashes)
                    if name is None or name in done:  # copies in other tasks fall to distinct()
                        continue
                    if len(done) < 1 << 16:
                        done.add(name)
                    own = ordered_prefix(hashes, shared.value, similarity)
                    token.append(own)
                    sig.append(np.full(len(own), name, np.int64))
                    n.append(np.full(len(own), len(hashes), np.int32))
                    pos.append(np.arange(len(own), dtype=np.int32))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ([t.view(np.int64) for t in token], sig, n, pos)], names=["token", "sig", "n", "pos"])
        release()

    prefix = write_scratch(texts.mapInArrow(prefixes, "token long, sig long, n int, pos int"), "prefixes")
    shared.destroy()
    common = write_scratch(repeated(read(prefix), max(1, -(-(n_shingles or 0) // 4_000_000))), "common")
    flagged = spark.sparkContext.broadcast(flags(read(common)))

    def perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without most of the shingles that only one set holds; the join does the rest."""
        for batch in batches:
            at = batch.column("token").to_numpy().view(U64) >> U64(64 - FILTER)
            yield batch.filter(pa.array((flagged.value[(at >> U64(3)).astype(np.int64)] >> (7 - (at & U64(7))).astype(np.uint8)) & 1 == 1))

    rows = stored(read(prefix).mapInArrow(perhaps, "token long, sig long, n int, pos int").join(read(common), "token", "left_semi").distinct(), "shared")
    flagged.destroy()
    release()
    drop_scratch(spark, prefix)
    drop_scratch(spark, common)

    def apart(now: DataFrame) -> DataFrame:
        """The rows of shingles that are held in more than one component, with the component."""
        roots = nodes.join(components(now), "node", "left")
        path = write_scratch(rows.join(roots.select("sig", F.coalesce("root", "node").alias("root")), "sig"), "placed")
        split = read(path).groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
        out = stored(read(path).join(split, "token", "left_semi"), "apart")
        drop_scratch(spark, path)
        return out

    def of_size(a: str, b: str):
        return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9

    def named_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                own = [shingle_set(raw, shingle, seed) for raw in raw_texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([signature(h) for h in own], pa.int64()), pa.array([h.tobytes() for h in own], pa.binary())], names=["sig", "h"])
        release()

    def links_of(pairs: DataFrame) -> DataFrame:
        """The links that (a, b) pairs of signatures prove; only the sets of these pairs are made."""
        pairs = stored(pairs, "pairs")
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(nodes, "sig").select("sig", "holder"), "wanted")
        sets = texts.join(wanted.select(F.col("holder").alias("id")).distinct(), "id", "left_semi").select("text").mapInArrow(named_sets, "sig long, h binary")
        path = write_scratch(sets.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "hashes")
        named = lambda c: nodes.select(F.col("sig").alias(c), F.col("node").alias("n" + c))
        found = _verified(pairs, read(path), similarity).join(named("a"), "a").join(named("b"), "b")
        out = stored(found.select(F.col("na").alias("a"), F.col("nb").alias("b")), "alike")
        drop_scratch(spark, path)
        return out

    now = apart(edges)
    hubs = now.groupBy("token").agg(F.min(F.struct("pos", "sig", "n", "root")).alias("hub"))
    star = now.join(hubs, "token").where((F.col("root") != F.col("hub.root")) & of_size("n", "hub.n"))
    star = star.groupBy("sig", F.col("hub.sig").alias("hub")).agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(F.max(F.struct("c", "hub")).alias("best"))
    edges = edges.unionByName(links_of(star.select(F.col("sig").alias("a"), F.col("best.hub").alias("b"))))

    # Of similar sets the first shared shingle, in the global order, leaves enough behind it in both: every
    # pair is met there, and a row of the join whose places rule that out need not be made.
    alpha = similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6
    now = apart(edges)
    one = lambda c: now.select("token", *[F.col(x).alias(x + c) for x in ("sig", "n", "pos", "root")])
    pairs = one("a").join(one("b"), "token").where((F.col("siga") < F.col("sigb")) & (F.col("roota") != F.col("rootb")) & of_size("na", "nb") & (F.least(F.expr("na - posa"), F.expr("nb - posb")) >= alpha))
    edges = edges.unionByName(links_of(pairs.select(F.col("siga").alias("a"), F.col("sigb").alias("b")).distinct()))
    edges = read(write_scratch(edges, "links"))
    for path in scratch:
        drop_scratch(spark, path)
    return edges


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text", bands: int | None = None, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in
    at most ``radius`` bits, the row's own included. With ``similarity``, texts whose
    fingerprints lie further apart are linked too if their shingle sets have that Jaccard
    similarity, all of them (``similar_links``), each on its whole text. Repeated rows each come back;
    rows that share a doc_id are one document with several texts. Rows with a null doc_id come back with component_id
    null and link nothing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = spark.read.parquet(write_scratch(fingerprints(docs, shingle, seed, doc_id, text, similarity is not None), "fp"))
    points = base.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    points = spark.read.parquet(write_scratch(points, "points"))
    edges = links(points, radius, bands)
    if similarity is not None:
        edges = similar_links(docs, base, points, edges, similarity, shingle, seed, doc_id, text)
    several = base.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    edges = edges.unionByName(base.join(several, "doc_id").join(points, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = components(edges)
    named = points.join(roots, points.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = base.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
