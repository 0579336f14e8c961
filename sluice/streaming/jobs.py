"""Running streaming queries over what is there now, and reading what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TIME

# Later than any event time; in the past of no window.
CLOSING = "2200-01-01 00:00:00"


def run_available(df: DataFrame, folder: str) -> list:
    """Processes all available input in append mode into parquet files below ``folder``; its last progress updates.

    Progress and state live in the same folder, so running it again goes on where it stopped.
    """
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress


def written(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def run_updates(df: DataFrame, folder: str) -> None:
    """Processes all available input in update mode; every micro-batch rewrites its own folder, also after a restart."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    (
        df.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )


def latest_updates(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    updates = spark.read.schema(numbered).option("basePath", f"{folder}/updates").parquet(f"{folder}/updates")
    values = [f.name for f in schema.fields if f.name not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*schema.names)


def publish(df: DataFrame, folder: str) -> str:
    """Writes rows as parquet files for a file stream to read; returns their folder."""
    path = f"{folder}/topic"
    df.write.parquet(path)
    return path


def stored_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType) -> DataFrame:
    """A stored table as a stream, from the same path as in batch; zoned timestamps, as watermarks need."""
    # A file stream takes folders and patterns only: this pattern matches the one name.
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{table[:-1]}[{table[-1]}].parquet")
    return zoned(rows)


def closing_row(rows: DataFrame) -> DataFrame:
    """A row that ends a topic: it lies beyond all others, so that the last windows and sessions close.

    Its numbers are -1, so that no join's null filter takes it out below the watermark; its own window never closes.
    """
    value = lambda f: CLOSING if f.name == TIME else -1 if isinstance(f.dataType, T.NumericType) else None
    return rows.sparkSession.range(1).select(*[
        F.lit(value(f)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def zoned(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in rows.schema.fields
    ])


def zoneless(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in rows.schema.fields
    ])
