"""Counts per key and hopping window of a stream, from panes that the watermark has closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timing import duration
from ..operators.windows import pane_counts
from .precombine import as_bytes, bucket_and_page, keyed

# State keys per state partition, each one call of the processor in a micro-batch.
BUCKETS_PER_PARTITION = 8

EARLIEST = -(1 << 62)


class HopTotals(StatefulProcessor):
    """State per bucket of keys: the closed panes that lie in windows still open, up to which instant windows have been
    given out, and the timer at the next end of a window. Windows that close in the micro-batch of their last pane never
    become state."""

    def __init__(self, key_type: pa.DataType, size: int, slide: int):
        self.size, self.slide = size, slide
        self.schema = pa.schema([("key", key_type), ("has_key", pa.bool_()), ("page", pa.int32()),
                                 ("pane", pa.int64()), ("num", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "panes binary, done bigint, alarm bigint")

    def _closed(self, panes: pd.DataFrame, done: int, now: int) -> pd.DataFrame:
        """The windows that end after ``done`` and not after ``now``."""
        parts, newest = [], panes["pane"] // self.slide * self.slide
        for back in range(-(-self.size // self.slide)):
            start = newest - back * self.slide
            end = start + self.size
            held = (end > panes["pane"]) & (end > done) & (end <= now)
            parts.append(panes.loc[held, ["key", "has_key", "num"]].assign(start=start[held]))
        return pd.concat(parts).groupby(["key", "has_key", "start"], as_index=False, sort=False)["num"].sum()

    def _advance(self, new: list[pd.DataFrame], now: int, fired: bool) -> Iterator[pd.DataFrame]:
        data, done, alarm = self.state.get() or (None, EARLIEST, None)
        held = [pa.ipc.open_stream(bytes(data)).read_pandas()] if data else []
        panes = pd.concat([*held, *new], ignore_index=True) if held or new else self.schema.empty_table().to_pandas()
        for _, part in panes.groupby("page", sort=False):
            closed = self._closed(part, done, now)
            if len(closed):
                yield closed[["key", "has_key", "num"]]
        kept = panes[panes["pane"] // self.slide * self.slide + self.size > now]
        # All panes that are kept lie in the window that ends next.
        wanted = -(-(now + self.slide - (now - self.size) % self.slide) // 1000) if len(kept) else None
        if alarm is not None and not fired and alarm != wanted:
            self.handle.deleteTimer(alarm)
        if wanted is not None and (fired or alarm != wanted):
            self.handle.registerTimer(wanted)
        table = pa.Table.from_pandas(kept[self.schema.names], self.schema, preserve_index=False)
        self.state.update((as_bytes(table) if len(kept) else None, max(done, now), wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        panes = [part[self.schema.names] for part in rows]
        yield from self._advance(panes, timerValues.getCurrentWatermarkInMs() * 1000, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        # The timer that went off is gone by itself.
        yield from self._advance([], now, True)

    def close(self) -> None:
        pass


def hop_totals_stream(rows: DataFrame, key: str, time: str, size: str, slide: str) -> DataFrame:
    """``key, num``: rows per key and hopping window, once the watermark has passed the window's end.

    Rows are counted per pane by Spark's own aggregate, which drops late rows and closes panes; windows are added up from
    closed panes, a bucket of keys per call.
    """
    kind = rows.schema[key].dataType
    micros = [int(duration(x).total_seconds() * 1_000_000) for x in (size, slide)]
    counted = keyed(pane_counts(rows, [key], time, size, slide), key)
    panes = bucket_and_page(counted, BUCKETS_PER_PARTITION).select(
        "bucket", "key", "has_key", "page", F.unix_micros("pane.start").alias("pane"), "num",
        F.window_time("pane").alias("closed"))
    output = T.StructType([T.StructField("key", kind), T.StructField("has_key", T.BooleanType()),
                           T.StructField("num", T.LongType())])
    totals = panes.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=HopTotals(to_arrow_type(kind), *micros), outputStructType=output, outputMode="Append",
        timeMode="EventTime")
    return totals.select(F.when(F.col("has_key"), F.col("key")).alias(key), "num")
