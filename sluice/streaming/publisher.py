"""Publishing tables in the order of event time, for file streams that take several micro-batches.

A file source reads files in the order in which they were written, so many at a time; rows of a later batch that lie
behind the watermark are lost. Topics are therefore cut at common points of event time and written slice after slice,
each slice as exactly so many files as a trigger takes (a pad row keeps a file that would be empty). A micro-batch is then
one slice of every topic: nothing is late, and joins that go by arrival see both sides up to the same instant. The closing
row comes last, in a file and a batch of its own.

Slices are staged by one job and then copied one by one, so publishing reads and writes the rows twice however many
slices there are. Within a slice the rows are dealt evenly over the files, also when they share one instant.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TIME
from .jobs import closing_row

SLICES = 3
PAD, FILE, SLICE = "_pad", "_file", "_slice"


def _instant(time: str = TIME) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def cut_points(rows: list[DataFrame], slices: int) -> list[int]:
    """Instants (microseconds) that cut the rows of all topics into about equal slices; fewer where instants repeat."""
    times = rows[0].select(_instant().alias("at"))
    for more in rows[1:]:
        times = times.unionByName(more.select(_instant().alias("at")))
    shares = [i / slices for i in range(1, slices)]
    if not shares:
        return []
    found, least = times.agg(F.percentile_approx("at", shares, 10_000), F.min("at")).first()
    return sorted({cut for cut in found or [] if cut > least})


def append_files(rows: DataFrame, path: str, files: int) -> None:
    """Adds the rows as exactly ``files`` files."""
    pads = rows.sparkSession.range(files).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields],
        F.lit(True).alias(PAD), F.col("id").cast("int").alias(FILE))
    dealt = rows.withColumns({PAD: F.lit(False), FILE: F.pmod(F.monotonically_increasing_id(), F.lit(files)).cast("int")})
    dealt.unionByName(pads).repartitionById(files, FILE).drop(FILE).write.mode("append").parquet(path)


@dataclass(frozen=True)
class OrderedTopic:
    """A published topic: where it lies, what its rows are, and how many files make a slice."""

    path: str
    schema: T.StructType
    files: int
    slices: int

    def stream(self, spark: SparkSession) -> DataFrame:
        """One slice per micro-batch."""
        padded = T.StructType([*self.schema.fields, T.StructField(PAD, T.BooleanType())])
        read = spark.readStream.schema(padded).option("maxFilesPerTrigger", self.files).parquet(self.path)
        return read.where(~F.col(PAD)).drop(PAD)


def publish_slices(rows: DataFrame, path: str, number: Column, slices: int, *, files: int) -> OrderedTopic:
    """Writes one topic in slices of the caller's choice, ``number`` (from 0) for each row; rows may so be out of order."""
    for at in range(slices):
        append_files(rows.where(number == at), path, files)
    append_files(closing_row(rows), path, 1)
    return OrderedTopic(path, rows.schema, files, slices)


def publish_in_order(topics: dict[str, DataFrame], folder: str, *, slices: int = SLICES, rows_per_slice: int | None = None,
                     files: int | None = None, closing: bool = True,
                     encode: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, OrderedTopic]:
    """Writes the topics slice after slice, cut at the same instants.

    ``rows_per_slice`` bounds what a trigger takes of all topics together (the rate of a replay) instead of ``slices``;
    a single instant is never cut. ``encode`` makes the stored rows out of a topic's rows, which have event times.
    """
    spark = next(iter(topics.values())).sparkSession
    files = files or spark.sparkContext.defaultParallelism
    if rows_per_slice:
        slices = max(1, -(-sum(rows.count() for rows in topics.values()) // rows_per_slice))
    cuts = cut_points(list(topics.values()), slices)
    number = F.lit(0)
    if cuts:
        # Rows without a time go to the first slice.
        number = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= _instant())), F.lit(0))
    stored = encode or (lambda topic, rows: rows)

    def publish(topic: str) -> OrderedTopic:
        rows, path, staged = topics[topic], f"{folder}/ordered-{topic}", f"{folder}/staged-{topic}"
        rows.withColumn(SLICE, number).write.partitionBy(SLICE).parquet(staged)
        sliced = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(SLICE, T.IntegerType())])).parquet(staged)
        for at in range(len(cuts) + 1):
            append_files(stored(topic, sliced.where(F.col(SLICE) == at).drop(SLICE)), path, files)
        last = stored(topic, closing_row(rows))
        if closing:
            append_files(last, path, 1)
        return OrderedTopic(path, last.schema, files, len(cuts) + 1)

    # Only the slices of one topic have to follow one another.
    with ThreadPoolExecutor(len(topics)) as pool:
        return dict(zip(topics, pool.map(publish, topics)))
