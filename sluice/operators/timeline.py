"""Operators that look back along a key's time line, without one task per key.

A key may hold a third of all rows, so its rows are never brought together. The line of a key is cut into slices; what
a slice needs from before its start is summed up per slice first, carried forward over the (few) slices of the key,
and added to the slice as one extra row. After that every (key, slice) is a group of its own. ``even_slices`` cuts the
time line where the rows are, so that neither a burst nor a long span makes a large group. Where the number of slices
grows with the rows, as in running sums by position, the slices are carried forward over spans of slices in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CARRIED = "_carried"  # 0: the row carried into a slice, 1: a row of the slice

# Slices of a span, over which sums are carried in one task.
SPAN_SLICES = 1_000


# Slices of time per partition of the shuffle, and how exact their borders are.
SLICES_PER_PARTITION, ACCURACY = 4, 10_000


def even_slices(frames: Sequence[DataFrame], time: str, slices: int | None = None) -> Callable[[str], Column]:
    """Slices of time that hold about equally many rows of all frames together, whatever the bursts and gaps.

    Their borders are approximate percentiles of the times, so a key with a third of the rows has a third of a slice's
    rows in each, and no more slices than there are in all. Only rows of one instant are never parted.
    """
    spark = frames[0].sparkSession
    slices = slices or SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = lambda column: F.unix_micros(F.col(column).cast("timestamp"))
    times = frames[0].select(at(time).alias("at"))
    for frame in frames[1:]:
        times = times.unionByName(frame.select(at(time).alias("at")))
    shares = [i / slices for i in range(1, slices)]
    found = times.agg(F.percentile_approx("at", shares, max(ACCURACY, 4 * slices))).first()[0] if shares else None
    cuts = sorted(set(found or ()))
    if not cuts:
        return lambda column: F.lit(0)
    borders, steps = F.lit(cuts), F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])

    def slice_of(column: str) -> Column:
        """How many borders lie at or before the time, by binary search."""
        def closer(place, step):
            behind = (place + step <= len(cuts)) & (F.get(borders, place + step - 1) <= at(column))
            return F.when(behind, place + step).otherwise(place)

        return F.aggregate(steps, F.lit(0), closer)

    return slice_of


def _place(df: DataFrame, order: list[str]) -> Column | None:
    """One number in the order of the columns, or None where they cannot be one; aggregates by it are hashed."""
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 1:
        return F.col(order[0])
    if len(order) > 2 or not isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType)) or not isinstance(kinds[1], T.IntegralType):
        return None
    wide = lambda column: column.cast("decimal(19, 0)").cast("decimal(38, 0)")
    return wide(F.unix_micros(F.col(order[0]).cast("timestamp"))) * F.lit(str(10 ** 19)).cast("decimal(20, 0)") + wide(F.col(order[1]))


def _so_far(keys: list[str], slice_name: str):
    return Window.partitionBy(*keys).orderBy(slice_name).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(totals: DataFrame, keys: list[str], span_by: Column | None) -> DataFrame:
    """Slices with ``_amount``, the total of a key's earlier slices; those without any are left out."""
    if span_by is None:
        carried = totals.withColumn("_amount", F.sum("_total").over(_so_far(keys, "_slice")))
        return carried.where(F.col("_amount").isNotNull()).select(*keys, "_slice", "_amount")
    spanned = totals.withColumn("_span", span_by)
    spans = spanned.groupBy(*keys, "_span").agg(F.sum("_total").alias("_total"))
    before = spans.withColumn("_total", F.sum("_total").over(_so_far(keys, "_span"))).where(F.col("_total").isNotNull())
    line = spanned.withColumn(_CARRIED, F.lit(1)).unionByName(
        before.withColumn(_CARRIED, F.lit(0)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_span").orderBy(_CARRIED, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    summed = line.withColumn("_amount", F.sum("_total").over(within))
    return summed.where((F.col(_CARRIED) == 1) & F.col("_amount").isNotNull()).select(*keys, "_slice", "_amount")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, amount: Column, name: str = "running",
    span_by: Column | None = None,
) -> DataFrame:
    """Adds the sum of ``amount`` over a key's rows up to and including each row.

    ``order`` must be unique within a key, and ``slice_by`` must rise (not strictly) along it. ``span_by`` makes spans of
    the column ``_slice`` and must rise along it too; without it a task carries the sum over all slices of a key.
    """
    rows = df.withColumn("_slice", slice_by).withColumn("_amount", amount)
    totals = rows.groupBy(*keys, "_slice").agg(F.sum("_amount").alias("_total"))
    carried = _sum_before(totals, keys, span_by).withColumn(_CARRIED, F.lit(0))
    line = rows.withColumn(_CARRIED, F.lit(1)).unionByName(carried, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_slice").orderBy(_CARRIED, *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = line.withColumn(name, F.sum("_amount").over(within))
    return summed.where(F.col(_CARRIED) == 1).drop(_CARRIED, "_slice", "_amount")


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, wanted: dict[str, str]
) -> DataFrame:
    """Adds the values that columns had in a key's previous row: ``wanted`` maps new names to columns.

    ``order`` must be unique within a key, and ``slice_by`` must rise (not strictly) along it.
    """
    columns = list(dict.fromkeys([*order, *wanted.values()]))
    rows = df.withColumn("_slice", slice_by)
    place = _place(df, order)
    if place is not None:  # plain columns keep this a hash aggregation
        last = F.struct(*[F.max_by(c, place).alias(c) for c in columns])
    else:
        last = F.max_by(F.struct(*columns), F.struct(*order))
    ends = rows.groupBy(*keys, "_slice").agg(last.alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_slice")
    carried = ends.withColumn("_before", F.lag("_end").over(before)).where(F.col("_before").isNotNull())
    line = rows.withColumn(_CARRIED, F.lit(1)).unionByName(
        carried.select(
            *keys, "_slice", F.lit(0).alias(_CARRIED), *[F.col("_before")[c].alias(c) for c in columns]
        ),
        allowMissingColumns=True,
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(_CARRIED, *order)
    looked = line.select("*", *[F.lag(column).over(within).alias(new) for new, column in wanted.items()])
    return looked.where(F.col(_CARRIED) == 1).drop(_CARRIED, "_slice")


def version_as_of(
    rows: DataFrame, versions: DataFrame, keys: list[str], time: str, slice_by, known: str, first: str
) -> DataFrame:
    """Adds to every row the version of its key at its time, and the key's first version.

    ``versions`` has the keys, the time and one struct column ``version``, one row per key and time. ``known`` is the
    latest version at or before the row's time (null if there is none yet), ``first`` the earliest version of all
    (null if the key has none). ``slice_by`` turns a time column into its slice.
    """
    rows = rows.withColumn("_slice", slice_by(time))
    versions = versions.select(*keys, time, "version", slice_by(time).alias("_slice"))
    known_slices = versions.groupBy(*keys, "_slice").agg(
        F.max_by("version", time).alias("_latest"), F.min_by("version", time).alias("_earliest")
    )
    asked_slices = rows.select(*keys, "_slice").distinct()
    slices = known_slices.withColumn("_order", F.lit(1)).unionByName(
        asked_slices.withColumn("_order", F.lit(0)), allowMissingColumns=True
    )
    # An asked slice sorts before the versions of its own time, so all rows before it are from earlier slices.
    in_order = Window.partitionBy(*keys).orderBy("_slice", "_order")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = slices.select(
        *keys, "_slice", "_order",
        F.last("_latest", ignorenulls=True).over(earlier).alias("version"),
        F.first("_earliest", ignorenulls=True).over(whole).alias(first),
    ).where("_order = 0")
    line = (
        rows.withColumn("_rank", F.lit(2))
        .unionByName(versions.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
        .unionByName(
            carried.select(*keys, "_slice", "version", first, F.lit(0).alias("_rank")), allowMissingColumns=True
        )
    )
    # The carried row has no time and sorts first; a version sorts before the rows of its own instant.
    within = Window.partitionBy(*keys, "_slice").orderBy(F.col(time).asc_nulls_first(), "_rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    matched = line.select(
        *[c for c in line.columns if c not in ("version", first)],
        F.last("version", ignorenulls=True).over(within).alias(known),
        F.first(first, ignorenulls=True).over(within).alias(first),
    )
    return matched.where("_rank = 2").drop("_rank", "_slice")
