"""Topic readers: raw records and typed rows, batch or stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TIME, topic_schema

RECORD_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

WATERMARK_DELAY = "4 seconds"

CORRUPT = "_corrupt_record"
ON_MALFORMED = ("fail", "null", "drop")


def kafka_records(
    spark: SparkSession,
    servers: str,
    topic: str,
    *,
    stream: bool = True,
    start: str = "latest",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Records of a Kafka topic from its end (``latest``) or its beginning (``earliest``).

    Needs the Kafka connector on the class path. Fetch sizes are the source's own options, e.g.
    ``maxOffsetsPerTrigger``, ``minOffsetsPerTrigger`` and ``maxTriggerDelay``. A batch read cannot start at the end.
    """
    if start not in ("latest", "earliest"):
        raise ValueError(f"start {start!r} is neither 'latest' nor 'earliest'")
    if not stream and start == "latest":
        raise ValueError("a batch read has nothing to read from the latest offset on")
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", start).options(**(options or {}))
    return reader.load().select(
        "topic", "partition", "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp"),
    )


def file_records(
    spark: SparkSession,
    path: str,
    *,
    stream: bool = False,
    start: str = "earliest",
    file_format: str = "json",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Records kept in files with the columns of :data:`RECORD_SCHEMA`.

    On a stream ``latest`` takes the newest files first; files have no end position to start from.
    """
    if start not in ("latest", "earliest"):
        raise ValueError(f"start {start!r} is neither 'latest' nor 'earliest'")
    reader = (spark.readStream if stream else spark.read).format(file_format).schema(RECORD_SCHEMA)
    if stream:
        reader = reader.option("latestFirst", str(start == "latest").lower())
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def parse(records: DataFrame, schema: T.StructType, on_malformed: str = "fail") -> DataFrame:
    """Typed rows of JSON records; records without a value are skipped.

    ``on_malformed``: ``fail`` stops the query, ``null`` gives a row of nulls, ``drop`` leaves the record out.
    """
    rows = records.where(F.col("value").isNotNull())
    return expand(rows, "value", schema, on_malformed).select(*[F.col(f"row.{f.name}") for f in schema.fields])


def expand(
    records: DataFrame,
    value: str,
    schema: T.StructType,
    on_malformed: str,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The records with a ``row`` struct parsed from their JSON value; ``keep`` tests the struct.

    The test sits in a generator and not in a filter, which Spark would move below the parsing by parsing twice.
    """
    if on_malformed not in ON_MALFORMED:
        raise ValueError(f"on_malformed {on_malformed!r} is not one of {ON_MALFORMED}")
    options = {"mode": "FAILFAST" if on_malformed == "fail" else "PERMISSIVE"}
    tests = [keep] if keep else []
    if on_malformed == "drop":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options["columnNameOfCorruptRecord"] = CORRUPT
        tests.append(lambda row: row[CORRUPT].isNull())
    parsed = F.from_json(value, schema, options)
    if not tests:
        return records.withColumn("row", parsed)
    passed = F.filter(F.array(parsed), lambda row: reduce(lambda a, b: a & b, [test(row) for test in tests]))
    return records.withColumn("row", F.explode(passed))


def typed_topic(
    records: DataFrame,
    topic: str,
    *,
    watermark: str | None = WATERMARK_DELAY,
    epoch_millis: bool = False,
    on_malformed: str = "fail",
) -> DataFrame:
    """A topic as typed rows. Streams get the bounded-delay watermark and zoned timestamps."""
    stream = records.isStreaming
    time_kind = "millis" if epoch_millis else ("ltz" if stream else "ntz")
    rows = parse(records, topic_schema(topic, time_kind), on_malformed)
    if epoch_millis:
        stamps = [f.name for f in topic_schema(topic, "ltz").fields if isinstance(f.dataType, T.TimestampType)]
        for name in stamps:
            stamp = F.timestamp_millis(name)
            rows = rows.withColumn(name, stamp if stream else stamp.cast("timestamp_ntz"))
    return with_watermark(rows, watermark)


def with_watermark(rows: DataFrame, delay: str | None = WATERMARK_DELAY) -> DataFrame:
    """Bounded-delay watermark on a stream whose rows still carry the event time.

    ``0 seconds`` is the monotonic watermark. A topic that falls silent holds back queries that also read other topics.
    """
    if delay is None or not rows.isStreaming or TIME not in rows.columns:
        return rows
    return rows.withWatermark(TIME, delay)
