"""Connected components of an undirected graph whose nodes are longs, by alternating stars.

Edges never leave the executors. Each round is two aggregations by node (partial before
the shuffle) and two joins whose large side Spark may split, so a star with a third of all
nodes doesn't land in one task. Each round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, write_scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges to (node, root): root is the smallest node of the component.

    Nodes without an edge and the roots themselves have no row. Self-loops, repeated edges and nulls are ignored.
    Raises if the graph hasn't settled after ``max_rounds`` rounds (the rounds needed grow
    with the logarithm of the longest chain).
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    path = write_scratch(now, "edges")
    state = None
    for _ in range(max_rounds):
        e = spark.read.parquet(path)
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, old = mark, path
        path = write_scratch(_small_star(_large_star(e).distinct()).distinct(), "edges")
        drop_scratch(spark, old)
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
