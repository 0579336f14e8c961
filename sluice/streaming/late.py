"""Late-row ledger: rows behind the watermark are split off before a window and kept instead of lost.

Spark drops a row whose window the watermark has passed, and counts it only in a query's progress. The ledger makes the
same decision per micro-batch and writes both parts down: what is in time goes on as a topic, what is late stays as rows.
A micro-batch is judged by the watermark that was in force one micro-batch before, as Spark judges it; the highest event
time of each micro-batch is written with its rows, so that a repeated micro-batch is split the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import duration
from ..schemas import TIME
from ..sources.topics import WATERMARK_DELAY

HIGHEST = "highest bigint, batch bigint"


class LateLedger:
    """Splits a stream of rows with event times; ``size`` is the width of the tumbling window that follows."""

    def __init__(self, folder: str, schema: T.StructType, *, size: str, delay: str = WATERMARK_DELAY):
        self.folder, self.size, self.schema = folder, size, schema
        self.delay_ms = int(duration(delay).total_seconds() * 1000)

    def bound_ms(self, spark: SparkSession, batch: int) -> int:
        """The watermark that decides over a micro-batch, in milliseconds: it knows the batches up to the last but one."""
        if batch < 2:
            return 0
        seen = spark.read.schema(HIGHEST).option("basePath", f"{self.folder}/highest").parquet(f"{self.folder}/highest")
        highest = seen.where(F.col("batch") <= batch - 2).agg(F.max("highest")).first()[0]
        return max(0, highest - self.delay_ms) if highest is not None else 0

    def split(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        ends = F.unix_millis(F.window(F.col(TIME).cast("timestamp"), self.size)["end"])
        late = F.coalesce(ends <= self.bound_ms(spark, batch), F.lit(False))
        rows.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{self.folder}/rows/batch={batch}")
        written = spark.read.schema(self.schema).parquet(f"{self.folder}/rows/batch={batch}")
        written.agg(F.max(F.unix_millis(F.col(TIME).cast("timestamp"))).alias("highest")).write.mode("overwrite").parquet(
            f"{self.folder}/highest/batch={batch}")

    def run(self, rows: DataFrame) -> None:
        """Splits all input that is there; another run goes on behind it."""
        rows.writeStream.foreachBatch(self.split).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows with ``late`` and the ``batch`` that brought them."""
        kept = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])
        return spark.read.schema(kept).option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")

    def in_time(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).where(~F.col("late")).select(*self.schema.names)

    def late(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).where("late").select(*self.schema.names, "batch")
