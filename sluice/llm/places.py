"""Dense positions of rows in sorted groups, without bringing a group to one task.

Rows are range-partitioned by group and order, so a group that holds a third of all rows lies in many partitions; a
position is the place in the partition and the sum of the group's rows in the partitions before. Only one row per
partition and group is summed that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import written

PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def ordered(df: DataFrame, keys: list[Column | str], purpose: str) -> DataFrame:
    """``df``, written in the order of ``keys`` (nulls first), with ``_part`` and the place ``_at`` in it.

    Rows that are equal in all keys are told apart by where they were read, so that repeats spread over partitions.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    sorted_rows = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*named, "_read")
    at = F.monotonically_increasing_id()
    return written(
        sorted_rows.sortWithinPartitions(*named, "_read").drop("_read").withColumn("_at", at)
        .withColumn("_part", F.shiftright("_at", PART_BITS).cast("int")), purpose)


def spans(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per group and partition: ``_shift``, what makes ``_at`` a position in the group (from 0), and ``_rows``."""
    firsts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return firsts.select(
        *group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), "_rows")


def positioned(rows: DataFrame, found: DataFrame, group: list[str], name: str) -> DataFrame:
    """``rows`` of ``ordered`` with the position ``name`` and the further columns of ``found``, which is made of ``spans``."""
    theirs = found.select(*[F.col(g).alias(f"_group{i}") for i, g in enumerate(group)], F.col("_part").alias("_its_part"),
                          *[c for c in found.columns if c not in (*group, "_part", "_rows")])
    same = F.col("_part") == F.col("_its_part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group{i}"))
    return rows.join(theirs, same).withColumn(name, F.col("_at") + F.col("_shift")).drop(
        "_at", "_part", "_its_part", "_shift", *[f"_group{i}" for i in range(len(group))])


def numbered(df: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """``df`` with the position ``name`` of each row in the order of ``keys``, from 0."""
    rows = ordered(df, keys, f"order-{name}")
    return positioned(rows, spans(rows, []), [], name)
