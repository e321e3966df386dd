"""Positions in large orders without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def with_position(df: DataFrame, keys: list[str], name: str = "global_pos", start: int = 0) -> DataFrame:
    """df with each row's position in the order of `keys`, which must be total.

    Rows are range-partitioned and written, so that the parts are fixed; positions inside a part come from a window over
    that part alone, and the parts' offsets from their counts (as many numbers as there are parts).
    """
    scratch = Scratch(df.sparkSession)
    parts = scratch.table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], start
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    table = df.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return parts.join(F.broadcast(table), "__part").withColumn(name, (F.col("__offset") + inside).cast("long")).drop("__part", "__offset")


def dense_ids(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Distinct values of `keys` with ids 0, 1, … in their order."""
    return with_position(df.select(*keys).distinct(), keys, name)


def occurrence(partition: list[str], order: list[str]) -> Column:
    """Index of a row among those of its partition, from 0."""
    return (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long")


def next_value(df: DataFrame, group: list[str], keys: list[str], value: Column, name: str) -> DataFrame:
    """df with the first non-null `value` of a later row of its group, in the order of `keys`; no group is one task's.

    Rows are range-partitioned by group and order and written. Within a part a window runs backwards, so that it only grows;
    what a part lacks comes from the parts after it, by one small table with a row a part and group.
    """
    scratch = Scratch(df.sparkSession)
    parts = scratch.table(df.withColumn("__value", value).repartitionByRange(*group, *keys).withColumn("__part", F.spark_partition_id()))
    back = Window.partitionBy(*group, "__part").orderBy(*[F.desc(c) for c in keys]).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.groupBy(*group, "__part").agg(F.min_by(F.col("__value"), F.when(F.col("__value").isNotNull(), F.struct(*keys))).alias("__first"))
    later = F.last("__first", ignorenulls=True).over(Window.partitionBy(*group).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))
    after = own.withColumn("__later", later).drop("__first")
    got = parts.withColumn(name, F.last("__value", ignorenulls=True).over(back)).join(after, [*group, "__part"], "left")
    return got.withColumn(name, F.coalesce(name, "__later")).drop("__value", "__part", "__later")
