"""Article dumps: pages from concatenated bzip2 XML streams, and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import ranked

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
        T.StructField("revision", T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))])),
    ]
)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, ns, redirect, text) of every page; an empty text element gives ''."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    return raw.select(F.col("id").alias("page_id"), "title", "ns", F.col("redirect._title").alias("redirect"), F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))


def kept(pages: DataFrame, namespace: int | None = 0, redirects: bool = False) -> DataFrame:
    """Pages of a namespace (None: all), without redirects unless asked."""
    out = pages if namespace is None else pages.where(F.col("ns") == namespace)
    return out if redirects else out.where("redirect IS NULL")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, offset, stream, title) from lines offset:page_id:title; streams count from 0 by offset."""
    line = r"^(\d+):(\d+):(.*)$"
    raw = spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 2).cast("long").alias("page_id"), F.regexp_extract("value", line, 1).cast("long").alias("offset"), F.regexp_extract("value", line, 3).alias("title"))
    streams = ranked(raw.select("offset").distinct(), "offset", name="stream", start=0)
    return raw.join(streams, "offset").select("page_id", "offset", "stream", "title")


def first(pages: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The first n pages in dump order (offset, then id)."""
    return pages.join(index.select("page_id", "offset"), "page_id").orderBy("offset", "page_id").limit(n)


def fetch(pages: DataFrame, ids: list[int]) -> DataFrame:
    """Pages by id; on a table sorted by page_id the filter skips most row groups."""
    return pages.where(F.col("page_id").isin(ids))
