"""Laying records out by key group over virtual partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keygroups as kg
from .scan import TopicCriteria, key_fields, with_key_row


def virtual_partitions(spark: SparkSession, topic: str, num_sources: int, num_partitions: int) -> DataFrame:
    """One row per virtual partition of a topic: its real partition and the reader that owns it."""
    return spark.range(num_sources * num_partitions).select(
        F.lit(topic).alias("topic"),
        F.col("id").cast("int").alias("virtual"),
        kg.origin_partition("id", num_sources, num_partitions).alias("origin"),
        kg.split_owner(F.lit(topic), F.col("id"), num_sources).alias("owner"),
    )


def virtuals_by_origin(mapping: DataFrame) -> DataFrame:
    """The virtual partitions of every real partition."""
    return mapping.groupBy("topic", "origin").agg(F.sort_array(F.collect_list("virtual")).alias("virtuals"))


def of_slot(df: DataFrame, fields, wanted: int, parallelism: int,
            max_parallelism: int = kg.DEFAULT_MAX_PARALLELISM) -> DataFrame:
    """Only the rows whose key belongs to one slot."""
    return df.where(kg.key_slot(fields, parallelism, max_parallelism) == wanted)


SLOT = "slot"


def write_by_slot(df: DataFrame, fields, path: str, parallelism: int, *, files_per_slot: int = 1,
                  max_parallelism: int = kg.DEFAULT_MAX_PARALLELISM) -> None:
    """Lays rows out in one folder per slot, so that the rows of a slot are read without looking at any others.

    The rows of a slot are dealt evenly over ``files_per_slot`` tasks, also when one key holds most of them.
    """
    dealt = df.withColumns({
        SLOT: kg.key_slot(fields, parallelism, max_parallelism),
        "_file": F.pmod(F.monotonically_increasing_id(), F.lit(files_per_slot)),
    })
    dealt.repartition(parallelism * files_per_slot, SLOT, "_file").drop("_file").write.partitionBy(SLOT).parquet(path)


def read_slots(spark: SparkSession, path: str, schema: T.StructType, *slots: int) -> DataFrame:
    """The rows of some slots of a laid-out table; files of other slots are not listed for reading."""
    laid_out = T.StructType([*schema.fields, T.StructField(SLOT, T.IntegerType())])
    return spark.read.schema(laid_out).parquet(path).where(F.col(SLOT).isin(*slots)).select(*schema.names)


# The mapping has num_sources x num_partitions rows, a cluster setting that does not grow with the records.
BROADCAST_MAPPING_ROWS = 100_000


def deal_out(
    records: DataFrame,
    topic: str,
    criteria: TopicCriteria,
    max_parallelism: int = kg.DEFAULT_MAX_PARALLELISM,
) -> DataFrame:
    """Adds ``slot`` and the ``virtual`` partition of the record's own partition whose owner is that slot.

    A slot may own several virtual partitions of one real partition; the lowest takes its records. Null when it owns
    none. The join keeps the records where they are: the mapping is tiny and is broadcast unless it is set up huge.
    """
    slots = kg.key_slot(key_fields(criteria), criteria.num_sources, max_parallelism)
    mapping = virtual_partitions(records.sparkSession, topic, criteria.num_sources, criteria.num_partitions)
    first = mapping.groupBy(F.col("origin").alias("partition"), F.col("owner").alias("slot")).agg(
        F.min("virtual").alias("virtual")
    )
    if criteria.num_sources * criteria.num_partitions <= BROADCAST_MAPPING_ROWS:
        first = F.broadcast(first)
    return with_key_row(records, criteria).withColumn("slot", slots).join(first, ["partition", "slot"], "left").select(
        *records.columns, "slot", "virtual"
    )


def by_virtual_partition(dealt: DataFrame, criteria: TopicCriteria) -> DataFrame:
    """Moves every dealt record to the Spark partition of its virtual partition."""
    return dealt.repartitionById(criteria.num_sources * criteria.num_partitions, "virtual")
