"""The topics as views over stored order, customer and event tables, and records and samples made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import JSON_WRITE
from ..schemas import TIME, TOPIC_COLUMNS
from .sinks import keyed_records

# The five auctions that the selection query asks for.
HOT_AUCTIONS = (1007, 1020, 2001, 2019, 2087)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def bid_from(events: DataFrame, *extra: str) -> DataFrame:
    """Bids from events; one in five goes to one of the hot auctions. ``extra`` keeps further event columns."""
    user = F.col("user_id") % 5
    hot = F.lit(HOT_AUCTIONS[-1])
    for place, auction in enumerate(HOT_AUCTIONS[:-1]):
        hot = F.when(user == place, F.lit(auction)).otherwise(hot)
    cold = F.lit(1000) + (F.col("event_id") * 7919) % 1200
    return events.select(
        F.when(F.col("event_id") % 5 == 0, hot).otherwise(cold).cast("bigint").alias("auction"),
        F.col("user_id").alias("bidder"),
        _cents("value").alias("price"),
        F.col("ts").alias(TIME),
        F.col("props").alias("extra"),
        *extra,
    )


def bid(spark: SparkSession, folder: str) -> DataFrame:
    return bid_from(table(spark, folder, "events"))


def auction_from(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("itemName"),
        F.col("o_orderstatus").alias("description"),
        F.round("o_totalprice").cast("bigint").alias("initialBid"),
        _cents("o_totalprice").alias("reserve"),
        (F.col("o_orderdate") + F.expr("INTERVAL '7' DAY")).alias("expires"),
        F.col("o_custkey").alias("seller"),
        (F.col("o_orderkey") % 20).alias("category"),
        F.col("o_orderdate").alias(TIME),
        F.col("o_orderstatus").alias("extra"),
    )


def auction(spark: SparkSession, folder: str) -> DataFrame:
    return auction_from(table(spark, folder, "orders"))


def person(spark: SparkSession, folder: str) -> DataFrame:
    """Persons from customers; a third of them appear 45 days before their first order."""
    first_order = (
        table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    )
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    state = F.lit("TX")
    for place, name in enumerate(("OR", "ID", "CA", "WA", "NY")):
        state = F.when(F.col("c_custkey") % 6 == place, F.lit(name)).otherwise(state)
    early = F.col("first_order") - F.expr("INTERVAL '45' DAY")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        first_order, F.col("c_custkey") == F.col("o_custkey")
    )
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat("c_name", F.lit("@example.com")).alias("emailAddress"),
        F.concat(F.lit("card-"), F.col("c_custkey").cast("string")).alias("creditCard"),
        F.col("n_name").alias("city"),
        state.alias("state"),
        F.when(F.col("c_custkey") % 3 == 0, early).otherwise(F.col("first_order")).alias(TIME),
        F.col("c_mktsegment").alias("extra"),
    )


BID_PARTITIONS = 4


def bid_records(spark: SparkSession, folder: str) -> DataFrame:
    """Bids as raw records of a topic with four partitions; the event id gives partition and offset."""
    names = [name for name, _ in TOPIC_COLUMNS["bid"]]
    rows = bid_from(table(spark, folder, "events"), "event_id")
    return rows.select(
        F.lit("bid").alias("topic"),
        (F.col("event_id") % BID_PARTITIONS).cast("int").alias("partition"),
        F.call_function("div", F.col("event_id"), F.lit(BID_PARTITIONS)).alias("offset"),
        F.col("auction").cast("string").alias("key"),
        F.to_json(F.struct(*names), JSON_WRITE).alias("value"),
    )


def person_records(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_records(person(spark, folder), "person").select(F.lit("person").alias("topic"), "key", "value")


def auction_records(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_records(auction(spark, folder), "auction").select(F.lit("auction").alias("topic"), "key", "value")


# Numbers of the measured queries and the two nominal rates (events per second).
MEASURED_QUERIES = (1, 2, 3, 5, 8, 11)
NOMINAL_RATES = (5_000, 50_000)


def metric_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of twelve measured runs, each with and without pushdown, made from the events.

    An event is one sample: its user gives the run and the replica, its type the service, its value the reading.
    """
    run = F.col("user_id") % 12
    query = F.element_at(F.array(*[F.lit(q) for q in MEASURED_QUERIES]), (run % 6 + 1).cast("int"))
    service = (
        F.when(F.col("event_type") == "click", F.lit("taskmanager"))
        .when(F.col("event_type") == "view", F.lit("storage"))
        .when(F.col("event_type") == "purchase", F.lit("proxy"))
        .when(F.col("event_type") == "signup", F.lit("taskmanager"))
        .otherwise(F.lit("source"))
    )
    metric = (
        F.when(F.col("event_type").isin("click", "view", "purchase"), F.lit("cpu_rate"))
        .when(F.col("event_type") == "signup", F.lit("network_rate"))
        .otherwise(F.lit("tput"))
    )
    return table(spark, folder, "events").select(
        run.alias("run_id"),
        query.alias("query"),
        F.when(run < 6, F.lit(1)).otherwise(F.lit(2)).alias("parallelism"),
        F.when(run % 2 == 0, F.lit(NOMINAL_RATES[0])).otherwise(F.lit(NOMINAL_RATES[1])).alias("throughput"),
        F.when(F.col("event_id") % 2 == 0, F.lit("plain")).otherwise(F.lit("pushed")).alias("variant"),
        service.alias("service"),
        (F.call_function("div", F.col("user_id"), F.lit(12)) % 2 + 1).cast("int").alias("replica"),
        metric.alias("metric"),
        "ts",
        _cents("value").alias("value"),
    )
