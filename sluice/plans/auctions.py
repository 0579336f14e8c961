"""The auction queries. Except where noted each takes batch or streaming frames alike."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import duration
from ..operators.emit_once import emit_once, salts_of, seller_salts
from ..operators.windows import early_firings, hop_counts, peak_rows, session_counts
from ..schemas import TIME, result_schema
from ..sources.mapped import HOT_AUCTIONS
from ..sources.sinks import conform

# Fixed values of the queries.
LOCAL_STATES = ("OR", "ID", "CA")
LOCAL_CATEGORY = 10
EURO_RATE = Decimal("0.908")
EURO_RATE_FLOAT = 0.82
FIRE_EVERY = 100_000


def _conform(df: DataFrame, query: str) -> DataFrame:
    return conform(df, result_schema(query, "ltz" if df.isStreaming else "ntz"))


def q0(bid: DataFrame) -> DataFrame:
    """Pass-through."""
    return bid.select("auction", "bidder", "price", TIME)


def q1(bid: DataFrame, rate: Decimal = EURO_RATE) -> DataFrame:
    """Prices in euros, exact to three places."""
    price = F.lit(rate) * F.col("price")
    return _conform(bid.select("auction", "bidder", price.alias("price"), TIME, "extra"), "q1")


def q1_float(bid: DataFrame, rate: float = EURO_RATE_FLOAT) -> DataFrame:
    """Prices in whole euros, converted in single precision and cut off."""
    price = F.lit(rate).cast("float") * F.col("price").cast("float")
    return bid.select("auction", price.cast("bigint").alias("price"), "bidder", TIME)


def q2(bid: DataFrame, auctions: Sequence[int] = HOT_AUCTIONS) -> DataFrame:
    """Bids on the listed auctions."""
    return bid.where(F.col("auction").isin(*auctions)).select("auction", "price")


def q2_modulo(bid: DataFrame, divisors: Sequence[int] = HOT_AUCTIONS) -> DataFrame:
    """Bids on auctions whose number one of the divisors divides."""
    divided = F.lit(False)
    for divisor in divisors:
        divided = divided | (F.col("auction") % divisor == 0)
    return bid.where(divided).select("auction", "price")


def q3(auction: DataFrame, person: DataFrame, *, states: Sequence[str] = LOCAL_STATES,
       category: int = LOCAL_CATEGORY, key_type: str = "bigint", hot: Sequence | None = None) -> DataFrame:
    """Who sells locally in a category, over all history.

    On streams both sides are kept as state for good, as the query asks.
    """
    items = auction.where(F.col("category") == category)
    return join_sellers(items, person.where(F.col("state").isin(*states)), key_type=key_type, hot=hot)


def join_sellers(items: DataFrame, sellers: DataFrame, *, key_type: str = "bigint", hot: Sequence | None = None) -> DataFrame:
    """Items with their sellers' details."""
    named = sellers.select(F.col("id").cast(key_type).alias("person_id"), "name", "city", "state")
    sold = items.select(F.col("seller").cast(key_type).alias("seller"), "id")
    same = F.col("seller") == F.col("person_id")
    return _of_seller(sold, named, same, "person_id", "id", hot).select("name", "city", "state", "id")


def _of_seller(items: DataFrame, persons: DataFrame, same, person_id: str, deal_by: str, hot: Sequence | None) -> DataFrame:
    """Items joined with their persons. In batch AQE splits a hot seller; on streams its items are dealt over salts, those
    of every seller if it is not known which ones may be hot."""
    if not items.isStreaming:
        return items.join(persons, same)
    salts, kind = seller_salts(items.sparkSession), items.schema["seller"].dataType.simpleString()
    number, _ = salts_of(F.col("seller"), salts, hot, kind)
    _, every_salt = salts_of(F.col(person_id), salts, hot, kind)
    dealt = items.withColumn("_salt", F.pmod(F.xxhash64(deal_by), number).cast("int"))
    spread = persons.withColumn("_person_salt", F.explode(every_salt))
    return dealt.join(spread, same & (F.col("_salt") == F.col("_person_salt")))


def q3_incremental(auction: DataFrame, person: DataFrame, *, states: Sequence[str] = LOCAL_STATES,
                   key_type: str = "bigint", time_slices: str | None = None) -> DataFrame:
    """Local sellers, each auction emitted once; all categories. Batch; ``streaming.emit_once`` is its stream twin."""
    local = person.where(F.col("state").isin(*states))
    return emit_once(auction, local, key_type=key_type, time_slices=time_slices)


def q5(bid: DataFrame, *, size: str = "10 seconds", slide: str = "2 seconds") -> DataFrame:
    """Hot items: the auctions with the most bids of every hopping window."""
    return peak_rows(hop_counts(bid, ["auction"], TIME, size, slide)).select("auction", "num")


def q5_counts(bid: DataFrame, *, size: str = "60 minutes", slide: str = "1 minute",
              key_type: str = "bigint") -> DataFrame:
    """Bids per auction and hopping window. On streams windows that overlap are added up from closed panes."""
    keyed = bid.select(F.col("auction").cast(key_type).alias("auction"), TIME)
    if bid.isStreaming and duration(size) > duration(slide):
        from ..streaming.hops import hop_totals_stream  # that package imports this module

        return hop_totals_stream(keyed, "auction", TIME, size, slide)
    return hop_counts(keyed, ["auction"], TIME, size, slide).select("auction", "num")


def q8(person: DataFrame, auction: DataFrame, *, size: str = "10 seconds") -> DataFrame:
    """Persons who appear and sell within the same window.

    In batch both sides are reduced to one row per key and window before they meet. On streams they are one aggregate
    over both topics, so that a seller's window is kept once and not also as the state of a join.
    """
    if person.isStreaming:
        return _q8_stream(person, auction, size)
    persons = person.groupBy("id", "name", F.window(TIME, size).alias("w")).agg(F.count(F.lit(1)).alias("_n"))
    sellers = auction.groupBy("seller", F.window(TIME, size).alias("seller_w")).agg(F.count(F.lit(1)).alias("_m"))
    same = (F.col("id") == F.col("seller")) & (F.col("w") == F.col("seller_w"))
    return persons.join(sellers, same).select("id", "name", F.col("w.start").alias("stime"))


def _q8_stream(person: DataFrame, auction: DataFrame, size: str) -> DataFrame:
    kind = person.schema["id"].dataType
    # A name may be null, its struct is not: sets leave nulls out.
    persons = person.select("id", F.struct("name").alias("person"), F.lit(False).alias("sells"), TIME)
    sellers = auction.select(
        F.col("seller").alias("id"), F.lit(None).cast(persons.schema["person"].dataType).alias("person"),
        F.lit(True).alias("sells"), TIME)
    both = persons.unionByName(sellers).where(F.col("id").isNotNull())
    met = both.groupBy("id", F.window(TIME, size).alias("w")).agg(
        F.collect_set("person").alias("persons"), F.max("sells").alias("sells"))
    named = met.where("sells").select("id", "w", F.explode("persons").alias("person"))
    return named.select(F.col("id").cast(kind).alias("id"), "person.name", F.col("w.start").alias("stime"))


def q8_pairs(person: DataFrame, auction: DataFrame, *, size: str = "10 seconds", hot: Sequence | None = None) -> DataFrame:
    """Every pair of a person and an auction of theirs within the same window."""
    persons = person.select("id", "name", F.window(TIME, size).alias("w"))
    items = auction.select("seller", "reserve", F.col("id").alias("item"), F.window(TIME, size).alias("seller_w"))
    same = (F.col("id") == F.col("seller")) & (F.col("w") == F.col("seller_w"))
    return _of_seller(items, persons, same, "id", "item", hot).select("id", "name", "reserve")


def q11(bid: DataFrame, *, gap: str = "10 seconds") -> DataFrame:
    """Bids per bidder and session."""
    counted = session_counts(bid, ["bidder"], TIME, gap)
    return _conform(counted.select("bidder", "num", "starttime", "endtime"), "q11")


def q11_composite(bid: DataFrame, *, gap: str = "10 seconds") -> DataFrame:
    """Bids per session of the same extra, auction and bidder."""
    keys = ["extra", "auction", "bidder"]
    return _conform(session_counts(bid, keys, TIME, gap).select(*keys, "num", "starttime", "endtime"), "q11_composite")


def q11_early(bid: DataFrame, *, gap: str = "10 seconds", every: int = FIRE_EVERY,
              key_type: str = "bigint") -> DataFrame:
    """Bids per bidder and session, also reported every ``every`` bids while the session grows.

    Batch; ``streaming.early_sessions`` is its stream twin.
    """
    keyed = bid.select(F.col("bidder").cast(key_type).alias("bidder"), TIME)
    sessions = session_counts(keyed, ["bidder"], TIME, gap)
    return early_firings(sessions, every).select("bidder", F.col("num").alias("bid_count"))
