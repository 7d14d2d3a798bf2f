"""The driver's parquet tables as the engine's data sets: nodes, edges, redirects, places, leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as articles: keys from 0 without gaps are their idx."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_partkey") + 100).alias("page_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links between parts, made of each line item's part and supplier."""
    n = table(spark, sf_dir, "part").count()
    linked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.pmod(7 * F.col("l_partkey") + 13 * F.col("l_suppkey"), F.lit(n)).alias("dst"), "l_linenumber")
    return linked.where("src <> dst").select("src", "dst").distinct()


def prose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second graph over the same nodes: links of first line items only."""
    n = table(spark, sf_dir, "part").count()
    linked = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("src"), F.pmod(7 * F.col("l_partkey") + 13 * F.col("l_suppkey"), F.lit(n)).alias("dst"))
    return linked.where("src <> dst").select("src", "dst").distinct()


def redirects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, redirects): customers lead to the customer before them, every thirteenth to a part; chains are up to 13 hops long."""
    n = table(spark, sf_dir, "part").count()
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    parts = nodes(spark, sf_dir)
    pages = parts.select("page_id", F.lit(0).alias("ns"), "title", F.lit(False).alias("is_redirect"), F.lit(50).cast("long").alias("length"))
    pages = pages.unionByName(c.select((key + 10_000_000).alias("page_id"), F.lit(0).alias("ns"), F.col("c_name").alias("title"), F.lit(True).alias("is_redirect"), F.lit(0).cast("long").alias("length")))
    before = c.select((key + 1).alias("c_custkey"), F.col("c_name").alias("before"))
    target = c.join(before, "c_custkey", "left").join(parts.select("idx", "title"), F.pmod(key, F.lit(n)) == F.col("idx"), "left")
    to = F.when(key % 13 == 0, F.col("title")).otherwise(F.col("before"))
    return pages, target.select((key + 10_000_000).alias("rd_from"), F.lit(0).alias("rd_namespace"), to.alias("rd_title"), F.lit("").alias("rd_interwiki"))


def geo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as coordinate tags of customers, some invalid, in text as a dump has them."""
    key = F.col("o_orderkey")
    kind = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        key.alias("gt_id"),
        F.col("o_custkey").alias("gt_page_id"),
        F.when(kind == "4-NOT SPECIFIED", "moon").otherwise("earth").alias("gt_globe"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("gt_primary"),
        (F.pmod(key * 37, F.lit(19000)) / 100.0 - 95.0).alias("gt_lat"),
        (F.pmod(key * 9173, F.lit(36000)) / 100.0 - 180.0).alias("gt_lon"),
        F.when(kind == "1-URGENT", F.concat(F.lit("city("), (key * 10).cast("string"))).when(kind == "2-HIGH", "river:us-oh").when(kind == "3-MEDIUM", "landmark").alias("gt_type"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: coordinates from the key, kind from the segment, languages and links from orders."""
    key = F.col("c_custkey")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("o_orderstatus") == "F").alias("langs"))
    joined = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    return joined.select(
        key.alias("page_id"),
        F.col("c_name").alias("title"),
        (F.pmod(key * 7919, F.lit(17000)) / 100.0 - 85.0).alias("lat"),
        (F.pmod(key * 104729, F.lit(36000)) / 100.0 - 180.0).alias("lon"),
        F.when(F.col("c_nationkey") % 5 > 0, F.col("c_mktsegment")).alias("type"),
        F.coalesce("langs", F.lit(0)).alias("langs"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles with a lead; very short ones count as disambiguation pages, longer ones as more popular."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("lead"), F.when(F.col("n_chars") < 40, 1).otherwise(0).alias("disambig"), "n_chars")
