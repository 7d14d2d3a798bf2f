"""Exact top-k inner products over norm-sorted blocks with SVD-rotated partial sums.

Components are turned into integers, floor(scale * x). Candidates are dealt to blocks of
bounded size by descending length; a length that many vectors share is cut into several
blocks. A rotation from the singular vectors of a bounded sample gathers most of the
length in the leading components; it only steers pruning and never the result.

First the queries meet the blocks of the longest vectors, which gives each a lower bound
for its k-th score. Then a query block meets exactly the candidate blocks whose longest
vector can still reach the bound of some query in it (|q| |p| >= bound). Inside a block
candidates go by descending length, in chunks; a chunk ends the block for all when no
query can gain from it. For the rest, the partial sum over the leading components plus the
Cauchy-Schwarz bound of the residual decides which pairs are worth the whole inner
product. Scores are exact integers, and bounds carry a slack for rounding.

Vectors so long that sums could pass 2^53 (norm over ``LONGEST``) stay out of these blocks.
They meet every other vector, as queries and as candidates, in blocks of their own: floating
sums with their error bound choose what can be among the k best, and those products are
summed as Python integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_scratch

#: Two vectors up to this length have products whose partial sums stay below 2^53.
LONGEST = float(1 << 26)
LOWEST = np.iinfo(np.int64).min
PACKED = "block long, longest double, ids binary, rows binary"


def quantised(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(id, dim, norm, q, wide) of the vectors without null or non-finite components: integers in q, or as doubles in wide beyond ``LONGEST``."""
    x = F.col("v")
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & x.isNotNull())
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # From 2^52 on every double is whole, and floor() would leave the range of a long.
    q = F.transform(x, lambda c: F.when(F.abs(c * scale) < float(1 << 52), F.floor(c * scale).cast("double")).otherwise(c * scale))
    out = whole.where(fine).select("id", q.alias("w"))
    out = out.select("id", F.size("w").alias("dim"), F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, c: a + c * c)).alias("norm"), "w")
    short = F.col("norm") <= LONGEST
    return out.select("id", "dim", "norm", F.when(short, F.col("w").cast("array<int>")).alias("q"), F.when(~short, F.col("w")).alias("wide"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim)


def _pack(dim: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        rows, norm, ids = _matrix(table.column("q"), dim), table.column("norm").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, -norm))
        return pa.table({"block": [key[0].as_py()], "longest": [float(norm.max())], "ids": [ids[order].tobytes()], "rows": [rows[order].tobytes()]})

    return pack


def _pack_wide(dim: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.column("wide").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.table({"block": [key[0].as_py()], "longest": [float(table.column("norm").to_numpy().max())], "ids": [table.column("id").to_numpy().tobytes()], "rows": [rows.tobytes()]})

    return pack


def exact_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row of q, vec_id, score) of each query's k best; q and c: whole numbers of any size as doubles."""
    if not (np.isfinite(q).all() and np.isfinite(c).all()):
        raise OverflowError("op4: a component passes the range of doubles after scaling")
    with np.errstate(all="ignore"):
        s = q @ c.T
        slack = (q.shape[1] + 2) * 2.0**-52 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
        low, high = s - slack, s + slack
    unsure = ~(np.isfinite(low) & np.isfinite(high))
    low[unsure], high[unsure] = -np.inf, np.inf
    out = []
    for i in range(len(qid)):
        others = np.flatnonzero(cid != qid[i])
        if len(others) > k:
            others = others[high[i, others] >= np.partition(low[i, others], len(others) - k)[len(others) - k]]
        own = [int(x) for x in q[i]]
        best = sorted((-sum(a * int(b) for a, b in zip(own, c[j].tolist(), strict=True)), int(cid[j])) for j in others.tolist())[:k]
        if any(not -(1 << 63) <= -x < 1 << 63 for x, _ in best):
            raise OverflowError("op4: a score passes the range of a long")
        out += [(i, j, -x) for x, j in best]
    return out


def _exact(queries: DataFrame, candidates: DataFrame, dim: int, k: int) -> DataFrame:
    """Every query block (qblock, q_ids, q_rows) with every candidate block (block, ids, rows), in whole numbers."""

    def rows_of(ids: np.ndarray, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.int32 if len(data) == 4 * len(ids) * dim else np.float64).reshape(-1, dim).astype(np.float64)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        get = lambda name: table.column(name)[0].as_py()
        qid, cid = np.frombuffer(get("q_ids"), np.int64), np.frombuffer(get("ids"), np.int64)
        best = exact_block(qid, rows_of(qid, get("q_rows")), cid, rows_of(cid, get("rows")), k)
        row, ids, score = (np.array([b[x] for b in best], np.int64) for x in range(3))
        return pa.table({"qblock": np.full(len(best), get("qblock"), np.int64), "row": row, "query_id": qid[row], "vec_id": ids, "score": score})

    both = queries.crossJoin(candidates.select("block", "ids", "rows"))
    return both.groupBy("block", "qblock").applyInArrow(run, "qblock long, row long, query_id long, vec_id long, score long")


class Best:
    """The k best candidates so far of each query: higher score, then smaller id."""

    def __init__(self, queries: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.q, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.queries = queries

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate((self.q, q)), np.concatenate((self.id, ids)), np.concatenate((self.score, score))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, np.arange(self.queries))
        rank = np.arange(len(q)) - first[q]
        kept = rank < self.k
        self.q, self.id, self.score = q[kept], ids[kept], score[kept]
        last = np.flatnonzero(rank == self.k - 1)
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])


def search_block(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, cid: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int, lead: int, chunk: int = 1024) -> Best:
    """The k best candidates of one block (rows by descending length) for each query; ``bound``: scores known to be reached."""
    best = Best(len(qid), k, bound)
    qf, rq = q.astype(np.float64), q @ rotation
    q_norm, q_rest = np.linalg.norm(qf, axis=1), np.linalg.norm(rq[:, lead:], axis=1)
    for a in range(0, len(cid), chunk):
        ids, rows = cid[a : a + chunk], c[a : a + chunk].astype(np.float64)
        slack = 1e-9 * (1 + np.linalg.norm(rows[0])) * (1 + q_norm)
        live = np.flatnonzero(q_norm * np.linalg.norm(rows[0]) + slack >= best.bound)
        if not len(live):
            break
        rc = rows @ rotation
        most = rq[live, :lead] @ rc[:, :lead].T + q_rest[live][:, None] * np.linalg.norm(rc[:, lead:], axis=1)[None, :]
        i, j = np.nonzero(most + slack[live][:, None] >= best.bound[live][:, None])
        if len(i) * 4 > most.size:
            # Most pairs survive: one product for all, and only what can be among the k best of this chunk goes on.
            s = (qf[live] @ rows.T).astype(np.int64)
            if np.isin(ids, qid).any():
                s[qid[live][:, None] == ids[None, :]] = LOWEST
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(live), LOWEST + 1)
            i, j = np.nonzero((s >= np.maximum(floor, best.bound[live])[:, None]) & (s > LOWEST))
            best.add(live[i], ids[j], s[i, j])
        else:
            i = live[i]
            other = qid[i] != ids[j]
            i, j = i[other], j[other]
            s = np.einsum("nd,nd->n", qf[i], rows[j]).astype(np.int64)
            good = s >= best.bound[i]
            best.add(i[good], ids[j[good]], s[good])
    return best


def _of_dim(rows: DataFrame, dim: int, k: int, is_query, block: int, query_block: int, lead: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """What the queries find, and the query blocks."""
    spark = rows.sparkSession
    n = rows.count()
    # Norm buckets, 256 at most, longest first; a bucket with more rows than a block is cut by a hash of the id.
    wanted = min(256, max(1, -(-n // block)))
    cuts = sorted(set(rows.agg(F.percentile_approx("norm", [i / wanted for i in range(1, wanted)] or [0.5], 10_000)).first()[0] or []), reverse=True)
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("norm")))
    placed = rows.withColumn("bucket", bucket)
    parts = [(r.bucket, max(1, -(-r["count"] // block))) for r in placed.groupBy("bucket").count().orderBy("bucket").collect()]
    start, at = {}, 0
    for b, g in parts:
        start[b], at = at, at + g
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("bucket"))
    placed = placed.withColumn("block", (lookup(start) + F.pmod(F.xxhash64("id"), lookup(dict(parts)))).cast("long"))
    candidates = spark.read.parquet(write_scratch(placed.groupBy("block").applyInArrow(_pack(dim), PACKED), "candidates"))
    asked = rows.where(is_query)
    groups = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long"))
    queries = spark.read.parquet(write_scratch(asked.groupBy("block").applyInArrow(_pack(dim), PACKED), "queries"))
    drawn = np.array([r.q for r in rows.select("q", "id").orderBy(F.xxhash64("id")).limit(sample).collect()], np.float64)
    rotation = np.linalg.svd(drawn, full_matrices=False)[2].T if len(drawn) >= dim else np.linalg.qr(np.random.default_rng(0).standard_normal((dim, dim)))[0]
    shared = spark.sparkContext.broadcast(rotation)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A query block with a candidate block: one row."""
        get = lambda name: table.column(name)[0].as_py()
        qid, cid = np.frombuffer(get("q_ids"), np.int64), np.frombuffer(get("ids"), np.int64)
        bound = np.full(len(qid), LOWEST + 1) if get("bound") is None else np.frombuffer(get("bound"), np.int64)
        best = search_block(qid, np.frombuffer(get("q_rows"), np.int32).reshape(-1, dim), bound, cid, np.frombuffer(get("rows"), np.int32).reshape(-1, dim), shared.value, k, min(lead, dim))
        return pa.table({"qblock": np.full(len(best.q), get("qblock")), "row": best.q, "query_id": qid[best.q], "vec_id": best.id, "score": best.score})

    found = "qblock long, row long, query_id long, vec_id long, score long"
    asked_all = queries.select(F.col("block").alias("qblock"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("longest").alias("q_longest"))
    # Lower bounds from the blocks of the longest vectors: the first block, of bounded size, goes to every query block.
    top = candidates.where("block = 0").select("ids", "rows")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("qblock")
    seeds = asked_all.join(top.select("ids", "rows", every), "qblock").withColumn("bound", F.lit(None).cast("binary"))
    seeds = seeds.withColumn("block", F.lit(0)).groupBy("block", "qblock").applyInArrow(run, found)
    kth = seeds.groupBy("qblock", "row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    kth = kth.groupBy("qblock").agg(F.collect_list(F.struct("row", "s")).alias("kth"))

    def bounds(batches):
        for batch in batches:
            out, reach = [], []
            for ids, rows_, known in zip(batch.column("q_ids").to_pylist(), batch.column("q_rows").to_pylist(), batch.column("kth").to_pylist(), strict=True):
                b = np.full(len(ids) // 8, LOWEST + 1)
                for x in known or ():
                    b[x["row"]] = x["s"]
                norm = np.linalg.norm(np.frombuffer(rows_, np.int32).reshape(-1, dim).astype(np.float64), axis=1)
                out.append(b.tobytes())
                # A block can matter only if its longest vector reaches this length (a query without length scores 0 everywhere).
                reach.append(float(np.where(norm > 0, b / np.maximum(norm, 1e-300), np.where(b <= 0, -np.inf, np.inf)).min()))
            yield pa.RecordBatch.from_arrays([batch.column("qblock"), batch.column("q_ids"), batch.column("q_rows"), pa.array(out, pa.binary()), pa.array(reach, pa.float64())], names=["qblock", "q_ids", "q_rows", "bound", "reach"])

    bounded = asked_all.join(kth, "qblock", "left").select("qblock", "q_ids", "q_rows", "kth").mapInArrow(bounds, "qblock long, q_ids binary, q_rows binary, bound binary, reach double")
    bounded = spark.read.parquet(write_scratch(bounded, "bounds"))
    # Which candidate block goes to which query block: block numbers and lengths only.
    pairs = candidates.select("block", "longest", every).join(bounded.select("qblock", "reach"), "qblock").where(F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("reach"))
    work = pairs.select("block", "qblock").join(candidates.select("block", "ids", "rows"), "block").join(bounded.drop("reach"), "qblock")
    work = work.repartition(max(1, min(4096, at * groups)), "block", "qblock")
    return work.groupBy("block", "qblock").applyInArrow(run, found), asked_all.select("qblock", "q_ids", "q_rows")


def _with_long(rows: DataFrame, asked: DataFrame | None, dim: int, k: int, is_query, block: int) -> list[DataFrame]:
    """What the queries of ``asked`` find among the long vectors, and long queries among all; ``rows`` of one dimension."""
    spark = rows.sparkSession

    def packed(part: DataFrame, name: str) -> DataFrame:
        groups = max(1, -(-part.count() // block))
        dealt = part.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
        return spark.read.parquet(write_scratch(dealt.groupBy("block").applyInArrow(_pack_wide(dim), PACKED), name))

    every = rows.select("id", "norm", F.coalesce("wide", F.col("q").cast("array<double>")).alias("wide"))
    long = every.where(F.col("norm") > LONGEST)
    out = [_exact(asked, packed(long, "long"), dim, k)] if asked is not None else []
    queries = packed(long.where(is_query), "longqueries").select((-1 - F.col("block")).alias("qblock"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    return [*out, _exact(queries, packed(every, "every"), dim, k)]


def _empty(rows: DataFrame, k: int, is_query) -> DataFrame:
    """Vectors without components: all score 0, so each query finds the smallest other ids."""
    from pyspark.sql import Window

    each = F.row_number().over(Window.partitionBy("id").orderBy("norm"))
    first = rows.select(F.col("id").alias("vec_id"), each.alias("n")).where(F.col("n") <= k).orderBy("vec_id").limit(2 * k).select("vec_id")
    asked = rows.where(is_query).select(F.lit(0).cast("long").alias("qblock"), F.monotonically_increasing_id().alias("row"), F.col("id").alias("query_id"))
    return asked.crossJoin(F.broadcast(first)).where("query_id <> vec_id").withColumn("score", F.lit(0).cast("long"))


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, block: int = 4096, query_block: int = 2048, lead: int = 16, sample: int = 8192, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows
    with another id. Ties go to the smaller vec_id; with fewer than k candidates all come
    back. Vectors that are null or hold null or non-finite components take no part, nor do
    those with a null id. Vectors of different lengths (dimensions) don't meet. Rows that
    repeat an id are candidates each, and each a query with its own ranks. An empty table
    gives an empty result. A score beyond the range of a long raises.
    """
    from pyspark.sql import Window

    spark = vectors.sparkSession
    rows = spark.read.parquet(write_scratch(quantised(vectors, scale, vec_id, embedding), "vectors"))
    is_query = F.col("id") % query_every == 0
    out = None
    kinds = rows.groupBy("dim").agg(F.max((is_query & (F.col("norm") <= LONGEST)).cast("int")).alias("asked"), F.max(is_query.cast("int")).alias("any"), F.max((F.col("norm") > LONGEST).cast("int")).alias("long"))
    for dim, asked, long in sorted((r.dim, r.asked, r.long) for r in kinds.where("any = 1").collect()):
        own, blocks, found = rows.where(F.col("dim") == dim), None, []
        if not dim:
            found = [_empty(own, k, is_query)]
        elif asked:
            near, blocks = _of_dim(own.where("q is not null").drop("wide"), dim, k, is_query, block, query_block, lead, sample)
            found = [near]
        if long:
            found += _with_long(own, blocks, dim, k, is_query, min(block, 1024))
        for part in found:
            part = part.withColumn("dim", F.lit(dim))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("dim", "qblock", "row").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
