"""Tables on shared storage: scratch tables, atomic data sets with a manifest, and fingerprints."""

from __future__ import annotations

import contextlib
import hashlib
import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only in local mode, and where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lexigraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows from a table in the shared folder: lineage ends there, and lost executors don't matter."""
    path = f"{scratch_root(df.sparkSession)}/lexigraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexigraph-" in folder:
            remove(df.sparkSession, folder)


def spread(df: DataFrame, small: int = 128 << 20) -> DataFrame:
    """A table estimated below ``small`` bytes dealt over all cores: it may lie in one row group, which one task reads.

    Larger ones have splits enough and aren't moved. The estimate is the optimizer's; nothing runs.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < small:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside and renamed over what was there in one step, so a reader sees the old file or the new one."""
    fs, p = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), over)


def read_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def write_dataset(df: DataFrame, path: str, meta: dict | None = None, by: str | None = None, sort: list[str] | None = None) -> None:
    """Writes a new version beside the old one and then publishes the manifest that names it, in one step.

    A crash at any point leaves the old manifest over the old version; the old version goes last.
    """
    spark, version = df.sparkSession, f"{path}/v-{uuid.uuid4().hex}"
    before = read_json(spark, f"{path}.meta.json") or {}
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(version, partitionBy=by)
    write_json(spark, f"{path}.meta.json", {"built": datetime.now(UTC).isoformat(timespec="microseconds"), "columns": df.columns, "data": version} | (meta or {}))
    if before.get("data"):
        remove(spark, before["data"])


def read_dataset(spark: SparkSession, path: str, **needed) -> DataFrame:
    """The data set, if its manifest is there and holds the values ``needed``; FileNotFoundError or RuntimeError else."""
    meta = read_json(spark, f"{path}.meta.json")
    if meta is None:
        raise FileNotFoundError(f"{path} isn't built")
    stale = {k: v for k, v in needed.items() if meta.get(k) != v}
    if stale:
        raise RuntimeError(f"{path} was built from other inputs: {sorted(stale)}")
    return spark.read.parquet(meta["data"])


def fingerprint(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:16]
