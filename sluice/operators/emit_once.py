"""Join that emits every auction once: with the seller known at that time, or with the first one to appear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import time_slice
from ..schemas import TIME
from .timeline import even_slices, version_as_of
from .windows import count_up

PERSON_FIELDS = ("name", "city", "state")

# On streams a seller's auctions are spread over state keys, as many as there are state partitions but not more than
# this, since every one of them keeps a copy of the person.
MOST_SALTS = 32


def seller_salts(spark: SparkSession) -> int:
    return min(MOST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


# A seller with this share of the rows may be a hot one.
HOT_SHARE = 0.01


def hot_sellers(auction: DataFrame) -> list:
    """Every seller with at least ``HOT_SHARE`` of the stored auctions, and some others, 1 / ``HOT_SHARE`` at most in all:
    counted in one pass that keeps no more sellers than that."""
    sold = auction.where("seller IS NOT NULL")
    return list(sold.stat.freqItems(["seller"], HOT_SHARE).first()[0] or ())


def salts_of(seller: Column, salts: int, hot: Sequence | None, kind: str) -> tuple[Column, Column]:
    """Over how many salts a seller is dealt, and all of these: one salt for sellers that are known not to be hot.

    ``hot`` None means that nothing is known of the sellers, so each of them is dealt over all salts.
    """
    if hot is None:
        spread = F.lit(True)
    else:
        spread = seller.isin(*[F.lit(h).cast(kind) for h in hot]) if hot else F.lit(False)
    number = F.when(spread, F.lit(salts)).otherwise(F.lit(1))
    return number, F.sequence(F.lit(0), number - 1)


def emit_once(auction: DataFrame, person: DataFrame, *, key_type: str = "bigint", time_slices: str | None = None) -> DataFrame:
    """``name, city, state, id`` in the order of event time.

    An auction whose seller is known is emitted with the seller's details as of its time. Otherwise it waits, in a set
    of ids per seller, for the seller's first appearance. A person comes before the auctions of the same instant; of
    several versions of a person at one instant the greatest counts. Sellers that never appear emit nothing.
    ``time_slices`` is the width of the slices of time that are worked off apart; without it they hold even parts of the rows.
    """
    versions = person.groupBy(F.col("id").cast(key_type).alias("seller"), TIME).agg(
        F.max(F.struct(*PERSON_FIELDS)).alias("version")
    )
    # Copies of an auction become one counted row before anything is put in order.
    rows = auction.groupBy(F.col("seller").cast(key_type).alias("seller"), "id", TIME).agg(
        F.count(F.lit(1)).alias("copies")
    )
    slice_of = (lambda time: time_slice(time, time_slices)) if time_slices else even_slices([auction, person], TIME)
    matched = version_as_of(rows, versions, ["seller"], TIME, slice_of, "known", "first").where(F.col("first").isNotNull())
    waited = F.col("known").isNull()
    emitted = (
        matched.select("seller", "id", "copies", waited.alias("waited"), F.coalesce("known", "first").alias("person"))
        .groupBy("seller", "id", "waited", "person")
        .agg(F.sum("copies").alias("copies"))
    )
    # Waiting ids are a set; known sellers emit every copy.
    copies = F.when(F.col("waited"), F.lit(1)).otherwise(F.col("copies")).cast("bigint")
    return count_up(emitted, F.lit(1).cast("bigint"), copies, "_copy").select(
        *[F.col("person")[f].alias(f) for f in PERSON_FIELDS], "id"
    )
