"""Global ranks, cumulative sums and bounded samples without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import settled

POSITION_BITS = 33  # monotonically_increasing_id keeps a row's place within its partition in so many bits


def ranked(df: DataFrame, *order: Column | str, name: str = "rank", start: int = 1) -> DataFrame:
    """The rows with their place in a total order, from ``start``.

    Rows are dealt by range and sorted inside partitions; a row's place is its place in the
    partition plus the rows of the partitions before. Only partition counts meet in one
    task. ``order`` should be total, or ties get an arbitrary order.
    """
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", POSITION_BITS)
    counts = placed.groupBy(part.alias("_part")).count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << POSITION_BITS) - 1) + start
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_at", "_part", "_before")


def running_sum(df: DataFrame, value: str, *order: Column | str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` up to and with each row, in a total order, dealt as in ``ranked``."""
    placed = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def percentile(rank: Column, n: Column) -> Column:
    """100 for rank 1, 0 for rank n."""
    return 100.0 * (n - rank) / F.greatest(n - 1, F.lit(1))
