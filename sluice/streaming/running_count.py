"""Running count per key, one output row per input row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import count_up
from .precombine import HELD_ROWS, as_bytes, bucket_and_page, combine_counts, keyed

# State keys per state partition, each one call of the processor in a micro-batch.
BUCKETS_PER_PARTITION = 8
KEY = ["page", "key", "has_key"]


class RunningCounts(StatefulProcessor):
    """State per bucket of keys, in pages: the rows of every key so far. Emits the ranges of counts that new rows take up.

    A call holds the keys of its bucket, not their rows, which are summed up as they come.
    """

    def __init__(self, key_type: pa.DataType):
        self.schema = pa.schema([("key", key_type), ("has_key", pa.bool_()), ("num", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "counts binary")

    def _added(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        held, size, total = [], 0, lambda parts: pd.concat(parts).groupby(KEY, as_index=False, sort=False)["num"].sum()
        for part in rows:
            held.append(part[[*KEY, "num"]])
            size += len(part)
            if size > max(HELD_ROWS, 2 * len(held[0])):
                held = [total(held)]
                size = len(held[0])
        return total(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for page, added in self._added(rows).groupby("page"):
            held = self.pages.getValue((int(page),))
            known = pa.ipc.open_stream(bytes(held[0])).read_pandas() if held else self.schema.empty_table().to_pandas()
            both = added.merge(known, on=["key", "has_key"], how="outer", suffixes=("", "_before"))
            before = both["num_before"].fillna(0).astype("int64")
            both["low"], both["high"] = before + 1, before + both["num"].fillna(0).astype("int64")
            yield both.loc[both["num"].notna(), ["key", "has_key", "low", "high"]]
            newest = both[["key", "has_key"]].assign(num=both["high"])
            self.pages.updateValue((int(page),), (as_bytes(pa.Table.from_pandas(newest, self.schema, preserve_index=False)),))

    def close(self) -> None:
        pass


def running_count_stream(rows: DataFrame, key: str) -> DataFrame:
    """``key, num``: for every row the number of its key's rows up to it, in order of arrival.

    Keys share buckets, so that a micro-batch is worked off in few calls, whatever the number of keys.
    """
    kind = rows.schema[key].dataType
    output = T.StructType([T.StructField("key", kind), T.StructField("has_key", T.BooleanType()),
                           T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    counted = bucket_and_page(keyed(combine_counts(rows, key), key), BUCKETS_PER_PARTITION)
    ranges = counted.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RunningCounts(to_arrow_type(kind)), outputStructType=output, outputMode="Append", timeMode="None"
    )
    numbered = count_up(ranges, F.col("low"), F.col("high"), "num")
    return numbered.select(F.when(F.col("has_key"), F.col("key")).alias(key), "num")
