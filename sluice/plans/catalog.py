"""Every query of the library over the stored tables, by name: ``{name: query(spark, folder)}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keygroups as kg
from ..functions.records import words
from ..operators import layout, routing
from ..operators.scan import Selection, TopicCriteria, scan_records, scan_stats, scan_topic
from ..operators.timeline import even_slices
from ..operators.windows import hop_counts
from ..schemas import TIME, topic_schema
from ..session import shared_folder
from ..sources import mapped, replay, sinks, topics
from ..sources.mapped import HOT_AUCTIONS, table
from ..sources.results import read_results, write_results
from . import auctions, metrics, pushdown, wordcount

# The stored events are minutes apart, so windows are longer than the queries' own seconds.
HOP = {"size": "10 hours", "slide": "2 hours"}
COUNT_HOP = {"size": "60 minutes", "slide": "5 minutes"}
TUMBLE = "30 days"
GAP = "6 hours"
FIRE_EVERY = 2

CATALOG = {}


def query(run):
    CATALOG[run.__name__] = run
    return run


# ---- auction queries ---------------------------------------------------------------------------------------------

@query
def q0(spark: SparkSession, folder: str) -> DataFrame:
    return auctions.q0(mapped.bid(spark, folder))


@query
def q1(spark, folder):
    return auctions.q1(mapped.bid(spark, folder))


@query
def q1_float(spark, folder):
    return auctions.q1_float(mapped.bid(spark, folder))


@query
def q2(spark, folder):
    """Through the topic scan: selection and projection on the JSON records."""
    criteria = TopicCriteria(selections=(Selection("auction", HOT_AUCTIONS),), projections=("auction", "price"))
    return scan_topic(mapped.bid_records(spark, folder), topic_schema("bid"), criteria, on_malformed="drop")


@query
def q2_typed(spark, folder):
    return auctions.q2(mapped.bid(spark, folder))


@query
def q2_pattern(spark, folder):
    criteria = TopicCriteria(selections=(Selection("auction", pattern="1007|1020"),), projections=("auction", "price"))
    return scan_topic(mapped.bid_records(spark, folder), topic_schema("bid"), criteria, on_malformed="drop")


@query
def q2_modulo(spark, folder):
    return auctions.q2_modulo(mapped.bid(spark, folder))


@query
def q3(spark, folder):
    return auctions.q3(mapped.auction(spark, folder), mapped.person(spark, folder))


@query
def q3_strkey(spark, folder):
    return auctions.q3(mapped.auction(spark, folder), mapped.person(spark, folder), key_type="string")


@query
def q3_incremental(spark, folder):
    return auctions.q3_incremental(mapped.auction(spark, folder), mapped.person(spark, folder))


@query
def q3_incremental_strkey(spark, folder):
    return auctions.q3_incremental(
        mapped.auction(spark, folder), mapped.person(spark, folder), key_type="string",
    )


@query
def q3_versions(spark, folder):
    """The emit-once join where a person changes: every order is also an address change of its customer's."""
    return auctions.q3_incremental(
        mapped.auction(spark, folder), person_versions(spark, folder), states=("OR", "ID", "CA", "WA"),
    )


def person_versions(spark, folder):
    """Persons that move with every order: the city is the order's priority, the state follows its number."""
    moves = table(spark, folder, "orders")
    states = F.array(*[F.lit(s) for s in ("OR", "ID", "CA", "WA", "NY", "TX")])
    return moves.select(
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("city"),
        F.element_at(states, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("state"),
        F.col("o_orderdate").alias(TIME),
    )


@query
def q5(spark, folder):
    return auctions.q5(mapped.bid(spark, folder), **HOP)


@query
def q5_counts(spark, folder):
    return auctions.q5_counts(mapped.bid(spark, folder), **COUNT_HOP)


@query
def q5_strkey(spark, folder):
    return auctions.q5_counts(mapped.bid(spark, folder), key_type="string", **HOP)


@query
def hop_windows(spark, folder):
    counts = hop_counts(mapped.bid(spark, folder), ["auction"], TIME, **HOP)
    return counts.select("auction", "num", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"))


@query
def q8(spark, folder):
    return auctions.q8(mapped.person(spark, folder), mapped.auction(spark, folder), size=TUMBLE)


@query
def q8_pairs(spark, folder):
    return auctions.q8_pairs(mapped.person(spark, folder), mapped.auction(spark, folder), size=TUMBLE)


@query
def q11(spark, folder):
    return auctions.q11(mapped.bid(spark, folder), gap=GAP)


@query
def q11_composite(spark, folder):
    return auctions.q11_composite(mapped.bid(spark, folder), gap=GAP)


@query
def q11_early(spark, folder):
    return auctions.q11_early(mapped.bid(spark, folder), gap=GAP, every=FIRE_EVERY)


@query
def q11_strkey(spark, folder):
    return auctions.q11_early(mapped.bid(spark, folder), gap=GAP, key_type="string")


# ---- topic scan --------------------------------------------------------------------------------------------------

SELECTED = TopicCriteria(
    selections=(Selection("auction", HOT_AUCTIONS),), projections=("auction", "bidder", TIME),
    partition_keys=(("auction", "long"),), num_sources=4, num_partitions=4,
)


@query
def scan_projection(spark, folder):
    """Projection only, typed."""
    criteria = TopicCriteria(projections=("bidder", TIME))
    return scan_topic(mapped.bid_records(spark, folder), topic_schema("bid"), criteria)


@query
def scan_unprojected_filter(spark, folder):
    """Selections on attributes that the output does not carry, one by value and one by pattern."""
    criteria = TopicCriteria(
        selections=(Selection("category", (10,)), Selection("itemName", pattern="^[12]-")), projections=("id", "seller"),
    )
    return scan_topic(mapped.auction_records(spark, folder), topic_schema("auction"), criteria)


@query
def scan_json(spark, folder):
    """JSON in, JSON out; the fields are read back for comparison."""
    kept = scan_records(mapped.bid_records(spark, folder), SELECTED)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return kept.select(
        "partition", "offset", "key", field("auction").cast("bigint").alias("auction"),
        field("bidder").cast("bigint").alias("bidder"), field("price").alias("price"),
    )


@query
def scan_passthrough(spark, folder):
    kept = scan_records(mapped.bid_records(spark, folder))
    return kept.select("topic", "partition", "offset", "key", F.get_json_object("value", "$.price").alias("price"))


@query
def scan_markers(spark, folder):
    """Selected records and the tail markers of the partitions."""
    criteria = TopicCriteria(selections=(Selection("auction", (1007,)),))
    kept = scan_records(mapped.bid_records(spark, folder), criteria, tail_marker=True)
    return kept.select("topic", "partition", "offset", "key", F.col("value").isNull().alias("marker"))


SAVINGS_CRITERIA = TopicCriteria(selections=(Selection("auction", HOT_AUCTIONS),), projections=("auction", "bidder"))


@query
def scan_savings(spark, folder):
    return scan_stats(mapped.bid_records(spark, folder), SAVINGS_CRITERIA)


def _records(spark, folder):
    return {
        "bid": mapped.bid_records(spark, folder),
        "auction": mapped.auction_records(spark, folder),
        "person": mapped.person_records(spark, folder),
    }


OVER_TOPICS = {"q0": {}, "q1": {}, "q2": {}, "q3": {}, "q5": HOP, "q8": {"size": TUMBLE}, "q11": {"gap": GAP}}


def _over_topics(name, parameters, pushed):
    def run(spark, folder):
        return pushdown.over_topics(name, _records(spark, folder), pushdown=pushed, on_malformed="drop", **parameters)

    run.__name__ = f"{'pushed' if pushed else 'unpushed'}_{name}"
    return run


for _name, _parameters in OVER_TOPICS.items():
    query(_over_topics(_name, _parameters, True))
query(_over_topics("q5", HOP, False))
query(_over_topics("q3", {}, False))


@query
def pushdown_savings(spark, folder):
    """Bytes that the pushdown of every query saves."""
    return pushdown.savings(_records(spark, folder))


@query
def scan_missing_attribute(spark, folder):
    """A pattern on an attribute that only some records have: the others pass."""
    events = table(spark, folder, "events")
    with_kind = F.to_json(F.struct("event_id", "event_type"))
    without_kind = F.to_json(F.struct("event_id"))
    records = events.select(
        F.lit("events").alias("topic"), F.col("event_id").cast("string").alias("key"),
        F.when(F.col("user_id") % 2 == 0, with_kind).otherwise(without_kind).alias("value"),
    )
    kept = scan_records(records, TopicCriteria(selections=(Selection("event_type", pattern="^(cl|er)"),)))
    return kept.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


@query
def scan_tombstones(spark, folder):
    """Every seventh record is a tombstone: a scan with criteria leaves them out."""
    records = mapped.bid_records(spark, folder)
    gone = records.withColumn("value", F.when(F.col("offset") % 7 != 0, F.col("value")))
    kept = scan_records(gone, TopicCriteria(projections=("price",)))
    return kept.select("partition", "offset", F.get_json_object("value", "$.price").alias("price"))


@query
def scan_value_kinds(spark, folder):
    """Pattern selection over attributes of all kinds of JSON values, told apart by the event number."""
    events = table(spark, folder, "events")
    kinds = [F.to_json(F.struct("event_id", value.alias("a")), {"ignoreNullFields": "false"}) for value in (
        F.col("event_id") % 8 == 0, F.lit(None).cast("string"), F.array("event_id"), F.col("event_type"))]
    records = events.select(
        F.lit("events").alias("topic"), F.lit(None).cast("string").alias("key"),
        F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int")).alias("value"))
    kept = scan_records(records, TopicCriteria(selections=(Selection("a", pattern="^(true|null|click|)$"),)))
    return kept.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


@query
def typed_source(spark, folder):
    return topics.typed_topic(mapped.person_records(spark, folder), "person")


@query
def keyed_sink(spark, folder):
    """Keyed JSON records of the auctions; one field is read back for comparison."""
    records = sinks.keyed_records(mapped.auction(spark, folder), "auction")
    return records.select("key", F.get_json_object("value", "$.seller").cast("bigint").alias("seller"))


@query
def event_mix(spark, folder):
    kinds = table(spark, folder, "events").select("event_id", replay.event_kind("event_id").alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("num"))


@query
def prefix_filter(spark, folder):
    """A prefix predicate on a string, as in the filter scenario."""
    records = mapped.person_records(spark, folder)
    criteria = TopicCriteria(selections=(Selection("name", pattern="^Customer#0+1.*"),), projections=("id", "name"))
    return scan_topic(records, topic_schema("person"), criteria, on_malformed="drop")


# ---- key groups --------------------------------------------------------------------------------------------------

@query
def keygroup_long(spark, folder):
    code = kg.java_hash("event_id", "long")
    events = table(spark, folder, "events").select("event_id", code.alias("hash"))
    group = kg.key_group("hash")
    return events.select("event_id", "hash", group.alias("keygroup"), kg.slot(group, 4).alias("slot"))


@query
def keygroup_string(spark, folder):
    events = table(spark, folder, "events").select("event_id", kg.java_hash("props", "string").alias("hash"))
    group = kg.key_group("hash")
    return events.select("event_id", "hash", group.alias("keygroup"), kg.slot(group, 3).alias("slot"))


@query
def keygroup_composite(spark, folder):
    fields = [("event_type", "string"), ("user_id", "long"), (F.col("event_id").cast("int"), "int")]
    events = table(spark, folder, "events").select("event_id", kg.composite_hash(fields).alias("hash"))
    return events.select("event_id", "hash", kg.key_group("hash").alias("keygroup"))


@query
def slot_filter(spark, folder):
    return layout.of_slot(mapped.bid(spark, folder), [("bidder", "long")], 1, 4).select("bidder", "price")


@query
def slot_layout(spark, folder):
    """The same rows out of a table that is laid out by slot, of which only this slot's files are read."""
    rows, path = mapped.bid(spark, folder).select("bidder", "price"), shared_folder(spark, "slot-layout")
    layout.write_by_slot(rows, [("bidder", "long")], path, 4, files_per_slot=2)
    return layout.read_slots(spark, path, rows.schema, 1)


@query
def split_owners(spark, folder):
    """Owner of every partition number in use, with the event type as topic."""
    events = table(spark, folder, "events").select("event_type", (F.col("user_id") % 8).alias("partition")).distinct()
    return events.select("event_type", "partition", kg.split_owner("event_type", "partition", 4).alias("owner"))


@query
def virtual_offsets(spark, folder):
    records = mapped.bid_records(spark, folder).select("partition", "offset")
    moved = records.withColumn("virtual_offset", kg.virtual_offset("offset", "partition", 4))
    return moved.withColumn("back", kg.real_offset("virtual_offset", "partition", 4))


@query
def virtual_origin(spark, folder):
    """Real partition of virtual ones, the user id serving as the virtual partition number."""
    users = table(spark, folder, "events").select("user_id").distinct()
    return users.select("user_id", kg.origin_partition("user_id", 3, 5).alias("origin"))


@query
def deal_out(spark, folder):
    dealt = layout.deal_out(mapped.bid_records(spark, folder), "bid", SELECTED)
    return dealt.select("partition", "offset", "slot", "virtual")


@query
def by_virtual_partition(spark, folder):
    """Records moved to their virtual partition, and whether they lie there."""
    owned = layout.deal_out(mapped.bid_records(spark, folder), "bid", SELECTED).where(F.col("virtual").isNotNull())
    moved = layout.by_virtual_partition(owned, SELECTED)
    return moved.select("partition", "offset", "virtual", (F.spark_partition_id() == F.col("virtual")).alias("in_place"))


@query
def virtuals_by_origin(spark, folder):
    """The virtual partitions of every real partition that holds bids."""
    mapping = layout.virtual_partitions(spark, "bid", SELECTED.num_sources, SELECTED.num_partitions)
    used = mapped.bid_records(spark, folder).select(F.col("partition").alias("origin")).distinct()
    found = layout.virtuals_by_origin(mapping.join(used, "origin", "left_semi"))
    return found.select("origin", F.explode("virtuals").alias("virtual"))


# ---- routing -----------------------------------------------------------------------------------------------------

RULES = (
    routing.Rule("edge-one", key="^sign", value="1"),
    routing.Rule("edge-two", key="i"),
    routing.Rule("edge-three", value='"k": [5-9]'),
)


@query
def route_rules(spark, folder):
    cluster = routing.route("event_type", "props", RULES, "core")
    return table(spark, folder, "events").select("event_id", cluster.alias("cluster"))


@query
def cluster_use(spark, folder):
    """Records of every cluster that the rules can name, also of those that get none."""
    known = routing.clusters(spark, (*RULES, routing.Rule("spare", key="no such key")), "core", "edge-local")
    used = route_rules(spark, folder).groupBy("cluster").agg(F.count("*").alias("records"))
    return known.join(used, "cluster", "left").select("cluster", F.coalesce("records", F.lit(0)).alias("records"))


@query
def results_csv(spark, folder):
    """Results written as files with a header and read again under their schema."""
    rows, path = auctions.q2(mapped.bid(spark, folder)), shared_folder(spark, "results")
    write_results(rows, path)
    return read_results(spark, path, rows.schema)


@query
def route_key_text(spark, folder):
    rules = (routing.Rule("edge-one", key="chase"), routing.Rule("edge-two", key="e"))
    cluster = routing.route_by_key_text("event_type", rules, "core")
    return table(spark, folder, "events").select("event_id", cluster.alias("cluster"))


@query
def route_load(spark, folder):
    """Records and bytes per cluster."""
    cluster = routing.route("event_type", "props", RULES, "core")
    size = F.octet_length("event_type") + F.octet_length("props")
    return table(spark, folder, "events").groupBy(cluster.alias("cluster")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(size).cast("bigint").alias("bytes")
    )


# ---- word counts -------------------------------------------------------------------------------------------------

@query
def wordcount_all(spark, folder):
    return wordcount.wordcount(table(spark, folder, "documents"))


@query
def wordcount_two_inputs(spark, folder):
    return wordcount.wordcount_two_inputs(table(spark, folder, "documents"), table(spark, folder, "conversations"))


@query
def wordcount_running(spark, folder):
    return wordcount.wordcount_running(table(spark, folder, "documents"), "doc_id", lines_per_slice=100)


@query
def wordcount_rebalanced(spark, folder):
    """Lines dealt out over all cores before they are split."""
    return wordcount.wordcount(table(spark, folder, "documents"), rebalance=spark.sparkContext.defaultParallelism)


@query
def words_per_line(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(words("text")).cast("bigint").alias("num"))


# ---- run metrics -------------------------------------------------------------------------------------------------

def _counter(spark, folder, time_slices=None):
    cents = F.round(F.col("value") * 100).cast("bigint")
    readings = table(spark, folder, "events").select("event_id", "ts", "event_type", cents.alias("step"))
    return metrics.counter(
        readings, ["event_type"], F.col("step"), tie=["event_id"], time_slices=time_slices, name="total"
    )


@query
def metric_counter(spark, folder):
    return _counter(spark, folder).select("event_type", "event_id", "total")


@query
def irate(spark, folder):
    slices = even_slices([table(spark, folder, "events")], "ts")
    rates = metrics.instant_rate(
        _counter(spark, folder, slices), ["event_type"], value="total", tie=["event_id"], window="10 minutes",
        time_slices=slices,
    )
    return rates.select("event_type", "event_id", F.round("rate", 6).alias("rate"))


@query
def irate_resets(spark, folder):
    """Rates of a counter that keeps starting over."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    readings = table(spark, folder, "events").select("event_id", "ts", "user_id", cents.alias("value"))
    rates = metrics.instant_rate(
        readings, ["user_id"], tie=["event_id"], window="12 hours"
    )
    return rates.select("user_id", "event_id", F.round("rate", 6).alias("rate"))


@query
def elapsed(spark, folder):
    samples = metrics.with_elapsed(mapped.metric_samples(spark, folder))
    return samples.select("run_id", "variant", "ts", "value", F.round("elapsed", 6).alias("elapsed"))


@query
def service_names(spark, folder):
    label = F.concat(
        F.lit('{name="bench_'), F.col("event_type"), F.lit("."), (F.col("user_id") % 3).cast("string"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("."), F.col("event_id").cast("string"))).otherwise(""),
        F.lit('"}'),
    )
    labelled = table(spark, folder, "events").select("event_id", label.alias("label"))
    return metrics.rename_series(labelled, "cpu").select("event_id", "series")


@query
def series_totals(spark, folder):
    samples = mapped.metric_samples(spark, folder).withColumn("ts", F.window("ts", "1 hour")["start"])
    return metrics.totals(samples, ["service"])


@query
def series_grand_total(spark, folder):
    """All series together."""
    return metrics.totals(mapped.metric_samples(spark, folder).withColumn("ts", F.window("ts", "1 hour")["start"]))


@query
def series_side_by_side(spark, folder):
    samples = mapped.metric_samples(spark, folder).withColumn("ts", F.window("ts", "1 hour")["start"])
    summed = metrics.totals(samples, ["service"]).withColumnRenamed("total", "value")
    return metrics.side_by_side(summed, ["taskmanager", "storage", "proxy", "source"], column="service")


@query
def warm_up_cut(spark, folder):
    samples = metrics.after_warm_up(mapped.metric_samples(spark, folder), warm_up="2 days")
    return samples.select("run_id", "variant", "ts", "service", "value")


@query
def expected_throughput(spark, folder):
    runs = mapped.metric_samples(spark, folder).select("run_id", "query", "throughput", "parallelism").distinct()
    expected = metrics.expected_throughput("query", "throughput", "parallelism")
    floor = metrics.expected_throughput("query", "throughput", "parallelism", metrics.FLOOR_RATIO)
    return runs.select("run_id", F.round(expected, 6).alias("expected"), F.round(floor, 6).alias("floor"))


@query
def above_floor(spark, folder):
    """Hourly samples, so that throughput and core use fall on the same instants."""
    hourly = mapped.metric_samples(spark, folder).withColumn("ts", F.window("ts", "1 hour")["start"])
    return metrics.above_floor(hourly).select("run_id", "variant", "service", "replica", "ts", "value")


@query
def role_usage(spark, folder):
    usage = metrics.role_usage(mapped.metric_samples(spark, folder))
    return usage.select("run_id", "variant", "role", F.round("usage", 6).alias("usage"))


@query
def variant_compare(spark, folder):
    samples = mapped.metric_samples(spark, folder)
    runs = samples.select("run_id").distinct().withColumn(
        "state", F.when(F.col("run_id") == 5, F.lit("failed")).otherwise(F.lit("executed"))
    )
    usage = metrics.role_usage(metrics.after_warm_up(samples, ["run_id", "variant"], warm_up="2 days"))
    compared = metrics.compare_variants(metrics.executed_runs(usage, runs))
    rounded = [F.round(c, 6).alias(c) for c in ("plain", "pushed", "ratio")]
    return compared.select("query", "parallelism", "throughput", "role", *rounded)


@query
def usage_by_pattern(spark, folder):
    """Usage where the replica is part of the service name and the roles are patterns of it."""
    samples = mapped.metric_samples(spark, folder)
    named = samples.withColumn("service", F.concat("service", F.lit("-"), F.col("replica").cast("string")))
    usage = metrics.role_usage(named, {"processing": "^task", "storage": "^storage-[0-9]+$", "proxy": "prox"})
    return usage.select("run_id", "variant", "role", F.round("usage", 6).alias("usage"))


@query
def stacked_series(spark, folder):
    """Totals per service and over all, in one long frame."""
    hourly = mapped.metric_samples(spark, folder).withColumn("ts", F.window("ts", "1 hour")["start"])
    return metrics.stacked(
        metrics.totals(hourly, ["service"]), metrics.totals(hourly).withColumn("service", F.lit("all")))


@query
def job_role_means(spark, folder):
    means = metrics.job_role_means(
        mapped.metric_samples(spark, folder), {"task": "^task", "proxy": "prox", "any": "."}
    )
    return means.select("variant", "role", F.round("mean_use", 6).alias("mean_use"))
