"""Writing results: declared schemas, keyed JSON records, discarding sinks and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.records import to_value
from ..schemas import TIME, TOPIC_KEYS


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``df`` by position under the names and types of a sink."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} columns do not fit a sink of {len(schema.fields)}")
    return df.select(*[
        F.col(source).cast(field.dataType).alias(field.name) for source, field in zip(df.columns, schema.fields)
    ])


def json_records(df: DataFrame) -> DataFrame:
    """Rows as JSON values, no key."""
    return df.select(to_value().alias("value"))


def keyed_records(df: DataFrame, topic: str) -> DataFrame:
    """Rows of a topic as records under the topic's decimal key."""
    return df.select(F.col(TOPIC_KEYS[topic]).cast("string").alias("key"), to_value().alias("value"))


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt out evenly over sink partitions."""
    return df.repartition(partitions)


def kafka_writer(df: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """At-least-once writer of ``key``/``value`` rows; needs the Kafka connector on the class path."""
    return (
        df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def discard_writer(df: DataFrame, checkpoint: str) -> DataStreamWriter:
    """Runs the query and throws the rows away."""
    return df.writeStream.format("noop").option("checkpointLocation", checkpoint)


LATENCY = "latency"


def with_latency(df: DataFrame, time: str = TIME) -> DataFrame:
    """Reports, per micro-batch, rows and the mean and highest age in milliseconds; see ``latency_rows``."""
    age = F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col(time).cast("timestamp"))
    return df.observe(LATENCY, F.count(F.lit(1)).alias("rows"), F.avg(age).alias("mean_ms"), F.max(age).alias("max_ms"))


def latency_rows(progress) -> list[dict]:
    """The latency reports in a query's ``recentProgress`` (or in events a listener kept)."""
    reports = []
    for update in progress:
        seen = update.observedMetrics.get(LATENCY)
        if seen is not None and seen["rows"]:
            reports.append({"batch": update.batchId, **seen.asDict()})
    return reports
