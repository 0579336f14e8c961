"""Replaying stored events as streams, and splitting a mixed event sequence into topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Events per topic out of every 50 (2 %, 6 % and 92 %).
MIX = {"person": 1, "auction": 3, "bid": 46}
MIX_CYCLE = 50


def replay_files(spark: SparkSession, path: str, schema: T.StructType, *, file_format: str = "parquet",
                 files_per_trigger: int = 1) -> DataFrame:
    """All stored rows as a stream, some files per trigger; the pace is the query's processing-time trigger."""
    return spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def event_kind(position) -> Column:
    """Topic of the event at a position of the mixed sequence."""
    place = F.pmod(F.col(position) if isinstance(position, str) else position, F.lit(MIX_CYCLE))
    person, auction = MIX["person"], MIX["person"] + MIX["auction"]
    return F.when(place < person, F.lit("person")).when(place < auction, F.lit("auction")).otherwise(F.lit("bid"))


def split_mix(events: DataFrame, position: str) -> dict[str, DataFrame]:
    """One frame per topic; each is a filter, so Spark reads only what the query asks for."""
    return {topic: events.where(event_kind(position) == topic) for topic in MIX}
