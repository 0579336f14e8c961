"""Counts over tumbling, hopping and session windows.

Both batch operators aggregate on the map side by key and a short piece of time before anything is shuffled by key
alone, so a key that holds a third of all rows reaches a task only as one row per piece of time.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import duration, interval


def tumbling(df: DataFrame, time: str, size: str, name: str = "w") -> DataFrame:
    return df.withColumn(name, F.window(time, size))


def hop_counts(df: DataFrame, keys: list[str], time: str, size: str, slide: str) -> DataFrame:
    """Rows per key and hopping window ``w``; works on batch and stream.

    Rows are counted once per pane, the widest that both size and slide are made of, and only the pane counts are spread
    over the windows that hold them, instead of every row size/slide times.
    """
    if duration(size) <= duration(slide):
        return df.groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("num"))
    whole = [int(duration(x).total_seconds() * 1_000_000) for x in (size, slide)]
    panes = pane_counts(df, keys, time, size, slide)
    if df.isStreaming:  # only Spark's own window carries the watermark on
        hops = panes.select(F.window("pane", size, slide).alias("w"), *keys, "num")
    elif whole[0] % whole[1]:  # which windows hold a pane depends on where it lies
        hops = panes.select(F.window("pane.start", size, slide).alias("w"), *keys, "num")
    else:
        steps = whole[0] // whole[1]
        starts = [F.col("pane.start") - F.lit(k * duration(slide)) for k in range(steps)]
        held_by = [F.struct(s.alias("start"), (s + interval(size)).alias("end")) for s in starts]
        hops = panes.select(F.explode(F.array(*held_by)).alias("w"), *keys, "num")
    return hops.groupBy("w", *keys).agg(F.sum("num").alias("num"))


def pane_counts(df: DataFrame, keys: list[str], time: str, size: str, slide: str) -> DataFrame:
    """Rows per key and ``pane``, the widest that both size and slide are made of."""
    pane = gcd(*[int(duration(x).total_seconds() * 1_000_000) for x in (size, slide)])
    return df.groupBy(F.window(time, f"{pane} microseconds").alias("pane"), *keys).agg(F.count(F.lit(1)).alias("num"))


def session_counts(df: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """Rows per key and session as ``starttime``, ``endtime`` (last row plus gap) and ``num``.

    A row exactly one gap after the last one still belongs to the session. Rows without a time belong to none.
    In batch, sessions are joined per slice of time first; only the first and last one of every slice, which may go on
    in another slice, are then put in order per key. No task meets more than a slice of a key, or two spans per slice.
    """
    if df.isStreaming:
        counted = df.groupBy(*keys, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("num"))
        return counted.select(*keys, F.col("s.start").alias("starttime"), F.col("s.end").alias("endtime"), "num")
    # Rows of one gap-wide grain are always in one session.
    grains = df.groupBy(*keys, F.window(time, gap).alias("grain")).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("num"))
    width = duration(gap) * SLICE_GRAINS
    sliced = grains.withColumn("slice", F.window("first", f"{int(width.total_seconds() * 1_000_000)} microseconds")["start"])
    local = _joined(sliced, [*keys, "slice"], gap)
    # The first and the last session of a slice may go on in another one; all others are whole and stay by themselves.
    border = (F.col("session") == 1) | (F.col("session") == F.max("session").over(Window.partitionBy(*keys, "slice")))
    parts = local.select(*keys, F.when(~border, F.col("slice")).alias("slice"), "first", "last", "num")
    return _joined(parts, [*keys, "slice"], gap).select(
        *keys, F.col("first").alias("starttime"), (F.col("last") + interval(gap)).alias("endtime"), "num")


# Gap-wide grains of a slice of time, whose sessions are joined in one task.
SLICE_GRAINS = 1_000


def _joined(spans: DataFrame, group: list[str], gap: str) -> DataFrame:
    """Spans ``first, last, num`` joined where no more than a gap lies between them, numbered from 1 in every group."""
    in_order = Window.partitionBy(*group).orderBy("first")
    previous = F.lag("last").over(in_order)
    opens = F.when(previous.isNull() | (F.col("first") > previous + interval(gap)), 1).otherwise(0)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = spans.withColumn("opens", opens).withColumn("session", F.sum("opens").over(so_far))
    return numbered.groupBy(*group, "session").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("num").alias("num"))


def early_firings(sessions: DataFrame, every: int, count: str = "num") -> DataFrame:
    """The counts a session reports: every ``every`` rows while it grows, and its final count when it ends."""
    n, step = F.col(count), F.lit(every).cast("bigint")
    growing = F.call_function("div", n, step)
    # One more firing than steps: the final one.
    fired = count_up(sessions, F.lit(1).cast("bigint"), growing + 1, "_firing")
    return fired.withColumn(count, F.least(n, F.col("_firing") * step)).drop("_firing")


# Numbers that one array holds while rows are multiplied.
BLOCK = 10_000


def count_up(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """One row per number from ``low`` to ``high``, in two steps so that no array grows with the range."""
    blocks = F.call_function("div", high - low, F.lit(BLOCK))
    started = df.select("*", low.alias("_low"), high.alias("_high")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks))
    )
    first = F.col("_low") + F.col("_block") * BLOCK
    last = F.least(first + (BLOCK - 1), F.col("_high"))
    return started.withColumn(name, F.explode(F.sequence(first, last))).drop("_low", "_high", "_block")


def peak_rows(counts: DataFrame, group: str = "w", count: str = "num") -> DataFrame:
    """The rows of every group whose count is the group's highest.

    The highest counts are aggregated first and joined back, so no group is ever sorted in one task. In batch the join
    is null-safe: it then adds no filters to one side only, and both sides read the same shuffled counts. On streams the
    rows of a group are dealt over salts, as many as there are state partitions.
    """
    if counts.isStreaming:
        # The state of a join has one task per key: a window alone would hold all counts of its time in one.
        salts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        others = [c for c in counts.columns if c not in (group, count)]
        salted = counts.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
        parts = salted.groupBy(F.col(group).alias("part_of"), "_salt").agg(F.max(count).alias("part"))
        peaks = parts.groupBy(F.col("part_of").alias("peak_of")).agg(F.max("part").alias("peak"))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        spread = peaks.select("peak_of", "peak", each.alias("peak_salt"))
        same = (F.col(group) == F.col("peak_of")) & (F.col("_salt") == F.col("peak_salt")) & (F.col(count) >= F.col("peak"))
        return salted.join(spread, same).drop("peak_of", "peak", "_salt", "peak_salt")
    peaks = counts.groupBy(F.col(group).alias("peak_of")).agg(F.max(count).alias("peak"))
    same = F.col(group).eqNullSafe(F.col("peak_of")) & F.col(count).eqNullSafe(F.col("peak"))
    return counts.join(peaks, same).drop("peak_of", "peak")
