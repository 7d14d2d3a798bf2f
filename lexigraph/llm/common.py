"""Shared pieces: text access in Arrow batches, sorted-key payloads, scratch tables.

Every operator reads texts as UTF-8 bytes. A null text counts as empty unless the
operator's docstring says otherwise. Names that start with ``_lx_`` are internal and
may not be used by input columns.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


# ---------------------------------------------------------------- columns and schemas


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id gives -1, which is no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(-1))


def extended(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema with these fields set: present ones replaced in place, others appended.

    Spark's names don't differ by case, so a present ``N_WORDS`` gives way to ``n_words``, under the new name.
    """
    new = {n.lower(): T.StructField(n, t, True) for n, t in fields}
    kept = [new.pop(f.name.lower(), f) for f in schema.fields]
    return T.StructType([*kept, *new.values()])


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch | pa.Table, columns: dict[str, pa.Array]) -> dict[str, pa.Array]:
    return {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | columns


def slices(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most about ``limit`` bytes of text, one row at least."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(value):
    """The value, after what was needed to make it has gone back to the system."""
    release()
    return value


# ---------------------------------------------------------------- hashing


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64's) over uint64 values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


# ---------------------------------------------------------------- sorted keys as bytes


def planes(x: np.ndarray) -> bytes:
    """Values as byte planes, so that leading zero bytes compress to nothing."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as byte planes of their differences."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, U64), dtype=U64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` (below 2^32) equal ranges of the key space each key falls in."""
    return ((keys >> U64(32)) * U64(buckets)) >> U64(32)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in the ascending keys; the end as well."""
    edges = np.array([-(-(i << 32) // buckets) << 32 for i in range(buckets)], U64)
    return np.append(np.searchsorted(keys, edges), len(keys))


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in local mode, and where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lexigraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def write_scratch(df: DataFrame, name: str, by: str | None = None, root: str | None = None) -> str:
    """Writes a table to the shared folder (or ``root``, shared too), and its path; the lineage ends there.

    Shuffle files of the write are removed once it has ended, where Spark offers that:
    nothing reads them again, and they would otherwise stay beside the table.
    """
    spark = df.sparkSession
    path = f"{root or scratch_root(spark)}/lexigraph-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.options(compression="zstd", **{"parquet.block.size": 32 << 20}).parquet(path, partitionBy=by)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_scratch(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
