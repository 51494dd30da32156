"""Positions in a group that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.session import materialise


def distributed_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the position (from 1) of each row in its group by ``order``.

    Rows are range-partitioned by group *and* order, so a group that holds a third of all rows is
    spread over a third of the tasks; local positions get the number of the group's rows in earlier
    partitions added. ``order`` should be total; ties get positions in an arbitrary but fixed order.
    Rows with null keys form a group of their own; an empty table gives an empty result.
    """
    cut = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    cut = materialise(cut, "ranked")
    part = F.shiftright("_at", 33)
    seen = cut.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the key as one value that is never null: null keys must meet their offsets
    same = F.struct(*keys) if keys else F.lit(0)
    offsets = seen.select(same.alias("_key"), "_part", "_from", before.alias("_before"))
    joined = cut.withColumn("_part", part).withColumn("_key", same).join(offsets, ["_key", "_part"]).drop("_key")
    return joined.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_from") + 1).cast("int")).drop("_at", "_part", "_from", "_before")


def top_n(df: DataFrame, keys: list[str], order, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark prunes inside each partition before the shuffle
    (WindowGroupLimit), so a hot group sends at most n rows a partition."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n)
