"""Session counts that also report while the session grows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timing import duration
from ..operators.windows import count_up
from ..plans.auctions import FIRE_EVERY
from ..schemas import TIME
from ..sources.topics import WATERMARK_DELAY
from .precombine import PAGES, as_bytes, bucket_and_page, combine_pieces, instants, keyed

# State keys per state partition, each one call of the processor in a micro-batch.
BUCKETS_PER_PARTITION = 8

START, SESSION = "first bigint", "last bigint, num bigint, since bigint"


def fired(num: int, since: int, added: int, every: int) -> tuple[range, int]:
    """Counts reported while ``added`` rows join a session of ``num`` rows, ``since`` of them after its last report, and
    how many rows the session then has after its last report."""
    if not added:
        return range(0), since
    first = max(every - since, 1)
    if added < first:
        return range(0), since + added
    reported = range(num + first, num + added + 1, every)
    return reported, num + added - reported[-1]


def firings(num: int, since: int, added: int, every: int) -> tuple[list[int], int]:
    """``fired`` with the counts as a list."""
    reported, since = fired(num, since, added, every)
    return list(reported), since


def _touched(sessions: list[tuple], firsts: list[int], first: int, last: int, gap: int) -> tuple[int, int]:
    """The open sessions within a gap of the span, as places in ``sessions``; sessions lie over a gap apart."""
    after = low = bisect_right(firsts, last + gap)
    while low and sessions[low - 1][1] + gap >= first:
        low -= 1
    return low, after


def joined(sessions: list[tuple], pieces: list[tuple], gap: int, every: int) -> Iterator[range]:
    """Adds the pieces (``first, last, num, steps``) of a key to its open ``sessions``, in order of time; yields the counts
    that are reported on the way.

    Pieces are shorter than a gap, so all rows of a piece fall into one session. Pieces of one grain of time are added at
    once where their first row already decides the session; only where later rows reach another session are they
    unpacked and taken instant by instant, as which row made a count complete then depends on the order.
    """
    firsts = [s[0] for s in sessions]
    for _, grain in groupby(sorted(pieces, key=lambda piece: piece[0]), key=lambda piece: piece[0] // gap):
        grain = list(grain)
        first, last = grain[0][0], max(p[1] for p in grain)
        if _touched(sessions, firsts, first, first, gap) == _touched(sessions, firsts, first, last, gap):
            spans = [(first, last, sum(p[2] for p in grain))]
        else:
            spans = [(at, at, num) for at, num in instants([(p[0], p[2], p[3]) for p in grain])]
        for first, last, num in spans:
            low, after = _touched(sessions, firsts, first, last, gap)
            held = sessions[low:after]
            counts, since = fired(sum(s[2] for s in held), sum(s[3] for s in held), num, every)
            start, end = min([first, *(s[0] for s in held)]), max([last, *(s[1] for s in held)])
            sessions[low:after] = [(start, end, sum(s[2] for s in held) + num, since)]
            firsts[low:after] = [start]
            if counts:
                yield counts


class EarlySessions(StatefulProcessor):
    """State per key: the open sessions by their start. A timer at the earliest end closes what the watermark passed.

    For few keys: every key is a call and some reads and writes of state. ``SessionBuckets`` does the same for many.
    """

    def __init__(self, key: str, gap_micros: int, every: int):
        self.key, self.gap, self.every = key, gap_micros, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", START, SESSION)

    def _sessions(self) -> list[tuple]:
        return sorted((start[0], *state) for start, state in self.open.iterator())

    def _store(self, before: list[tuple], after: list[tuple], alarm: int | None) -> None:
        """Writes the sessions that changed, and the timer if its time did; ``alarm`` is the timer that is set."""
        old, new = {s[0]: s[1:] for s in before}, {s[0]: s[1:] for s in after}
        for start in old.keys() - new.keys():
            self.open.removeKey((start,))
        for start, state in new.items():
            if old.get(start) != state:
                self.open.updateValue((start,), state)
        wanted = self._alarm(after)
        if wanted != alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            if wanted is not None:
                self.handle.registerTimer(wanted)

    def _alarm(self, sessions: list[tuple]) -> int | None:
        if not sessions:
            return None
        return -(-(min(s[1] for s in sessions) + self.gap) // 1000)

    def _output(self, key, counts: range) -> Iterator[Row]:
        """The counts as one row, however many they are."""
        if counts:
            yield Row(**{self.key: key[0], "low": counts[0], "high": counts[-1], "step": counts.step})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._sessions()
        sessions = list(before)
        for counts in joined(sessions, [(r["first"], r["last"], r["num"], r["steps"]) for r in rows], self.gap, self.every):
            yield from self._output(key, counts)
        self._store(before, sessions, self._alarm(before))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        sessions = self._sessions()
        # The timer that went off is gone by itself.
        self._store(sessions, [s for s in sessions if s[1] + self.gap > now], None)
        for session in sessions:
            if session[1] + self.gap <= now:
                yield from self._output(key, range(session[2], session[2] + 1))

    def close(self) -> None:
        pass


class SessionBuckets(StatefulProcessor):
    """State per bucket of keys, in pages: the open sessions of the keys. A call reads the pages of the keys in its rows
    and writes them; the bucket has one timer, not after the earliest end of its sessions, which closes what the watermark
    passed."""

    def __init__(self, key_type: pa.DataType, gap_micros: int, every: int):
        self.gap, self.every = gap_micros, every
        longs = [(c, pa.int64()) for c in ("start", "last", "num", "since")]
        self.schema = pa.schema([("key", key_type), ("has_key", pa.bool_()), *longs])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "sessions binary")
        self.alarm = handle.getValueState("alarm", "at bigint")

    def _held(self, data) -> dict[tuple, list[tuple]]:
        """The open sessions of a page by key and whether it is one, in order."""
        sessions = {}
        for key, has_key, *session in zip(*pa.ipc.open_stream(bytes(data)).read_all().to_pydict().values()) if data else ():
            sessions.setdefault((key, has_key), []).append(tuple(session))
        return sessions

    def _keep(self, page: int, sessions: dict[tuple, list[tuple]]) -> None:
        rows = [(*key, *session) for key, line in sessions.items() for session in line]
        if rows:
            arrays = [pa.array(values, f.type) for values, f in zip(zip(*rows), self.schema)]
            self.pages.updateValue((page,), (as_bytes(pa.Table.from_arrays(arrays, schema=self.schema)),))
        else:
            self.pages.removeKey((page,))

    def _set_alarm(self, held: int | None, wanted: int | None) -> None:
        if held == wanted:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        if wanted is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(wanted)
            self.alarm.update((wanted,))

    def _ends(self, sessions: dict[tuple, list[tuple]]) -> list[int]:
        """When the sessions are over, in milliseconds."""
        return [-(-(session[1] + self.gap) // 1000) for line in sessions.values() for session in line]

    def _reports(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame(found, columns=["key", "has_key", "low", "high", "step"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat([part for part in rows], ignore_index=True)
        table = table.sort_values(["page", "has_key", "key"], kind="stable")
        found, earliest = [], []
        for page, part in table.groupby("page", sort=False):
            held = self.pages.getValue((int(page),))
            sessions = self._held(held[0] if held else None)
            columns = [part[c].tolist() for c in ("key", "has_key", "first", "last", "num", "steps")]
            for name, pieces in groupby(zip(*columns), key=lambda row: row[:2]):
                line = sessions.setdefault(name, [])
                pieces = [piece[2:] for piece in pieces]
                found += [(*name, c[0], c[-1], c.step) for c in joined(line, pieces, self.gap, self.every)]
            self._keep(int(page), sessions)
            earliest.append(min(self._ends(sessions)))
            if len(found) > HELD_REPORTS:
                yield from self._reports(found)
                found = []
        yield from self._reports(found)
        alarm = (self.alarm.get() or (None,))[0]
        self._set_alarm(alarm, min(earliest) if alarm is None else min(alarm, *earliest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        earliest = []
        for (page,), (data,) in list(self.pages.iterator()):
            sessions = self._held(data)
            over = [(*name, s[2], s[2], 1) for name, line in sessions.items() for s in line if s[1] + self.gap <= now]
            if over:
                sessions = {name: [s for s in line if s[1] + self.gap > now] for name, line in sessions.items()}
                sessions = {name: line for name, line in sessions.items() if line}
                self._keep(page, sessions)
                yield from self._reports(over)
            earliest += self._ends(sessions)
        # The timer that went off is gone by itself.
        self.alarm.clear()
        self._set_alarm(None, min(earliest, default=None))

    def close(self) -> None:
        pass


# Reports that a call hands on together.
HELD_REPORTS = 100_000


def early_sessions_stream(bid: DataFrame, *, gap: str = "10 seconds", every: int = FIRE_EVERY, key: str = "bidder",
                          delay: str = WATERMARK_DELAY) -> DataFrame:
    """``bidder, bid_count``: a row for every ``every`` bids of a growing session and one when it ends.

    ``bid`` needs no watermark of its own. Bids of one bidder in one gap-wide grain of time are one row per task, with
    their instants as steps from the first; such a row is late only if its last bid is. Bidders share buckets, so that a
    micro-batch is worked off in few calls, whatever the number of bidders.
    """
    micros = int(duration(gap).total_seconds() * 1_000_000)
    kind = bid.schema[key].dataType
    pieces = keyed(combine_pieces(bid, key, TIME, micros), key)
    timed = bucket_and_page(pieces, BUCKETS_PER_PARTITION).withColumn(
        TIME, F.timestamp_micros("last")).withWatermark(TIME, delay)
    output = T.StructType([T.StructField("key", kind), T.StructField("has_key", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("low", "high", "step")]])
    reported = timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SessionBuckets(to_arrow_type(kind), micros, every), outputStructType=output, outputMode="Append",
        timeMode="EventTime",
    )
    steps = F.call_function("div", F.col("high") - F.col("low"), F.col("step"))
    counted = count_up(reported, F.lit(0).cast("bigint"), steps, "_step")
    return counted.select(F.when(F.col("has_key"), F.col("key")).alias(key),
                          (F.col("low") + F.col("_step") * F.col("step")).alias("bid_count"))
