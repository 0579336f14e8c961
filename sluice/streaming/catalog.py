"""Queries of the catalog that run as streams: over all stored rows, until the input is used up.

Each writes its result to a folder of its own below the shared folder and returns it. Queries whose results depend on
the order of events read topics that are published slice after slice in the order of event time (``publisher``), one
slice per micro-batch; with windows or sessions a closing row follows, so that their results are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.emit_once import hot_sellers
from ..operators.scan import Selection, TopicCriteria, observed_scan, scan_topic
from ..plans import auctions, catalog, pushdown, wordcount
from ..schemas import TIME, topic_schema
from ..session import shared_folder, stream_session
from ..sources import mapped, sinks, topics
from ..sources.mapped import HOT_AUCTIONS, table
from ..sources.topics import WATERMARK_DELAY, with_watermark
from . import jobs, reports
from .early_sessions import early_sessions_stream
from .emit_once import emit_once_stream
from .late import LateLedger
from .publisher import publish_in_order, publish_slices
from .running_count import running_count_stream

CATALOG = {}


def stream_query(run):
    """Registers ``run(spark, folder, out) -> streaming frame`` as a query that runs it to the end of the input."""

    def execute(spark: SparkSession, folder: str) -> DataFrame:
        out = shared_folder(spark, run.__name__)
        result = jobs.zoneless(run(stream_session(spark, count_state=False), folder, out))
        jobs.run_available(result, out)
        return jobs.written(spark, out, result.schema)

    execute.__name__, execute.__doc__ = run.__name__, run.__doc__
    CATALOG[run.__name__] = execute
    return execute


def _stored(spark, folder, name):
    return jobs.stored_stream(spark, folder, name, table(spark, folder, name).schema)


def _bid(spark, folder):
    return with_watermark(mapped.bid_from(_stored(spark, folder, "events")))


def _auction(spark, folder):
    return with_watermark(mapped.auction_from(_stored(spark, folder, "orders")))


def _published(spark, rows, out):
    """Rows that only a batch query can make, written down and streamed from there."""
    stream = spark.readStream.schema(rows.schema).parquet(jobs.publish(rows, out))
    return with_watermark(jobs.zoned(stream))


def _person(spark, folder, out):
    return _published(spark, mapped.person(spark, folder), out)


MAPPED = {"bid": mapped.bid, "auction": mapped.auction, "person": mapped.person}


def _in_order(spark, folder, out, *names, closing=True, watermark=WATERMARK_DELAY, **rows):
    """The topics in the order of event time, cut at common instants; ``rows`` takes the place of a topic's rows."""
    made = publish_in_order({n: rows[n] if n in rows else MAPPED[n](spark, folder) for n in names}, out, closing=closing)
    streams = [with_watermark(jobs.zoned(topic.stream(spark)), watermark) for topic in made.values()]
    return streams[0] if len(streams) == 1 else streams


def _hot(spark, folder):
    return hot_sellers(mapped.auction(spark, folder))


@stream_query
def stream_q0(spark, folder, out):
    return auctions.q0(_bid(spark, folder))


@stream_query
def stream_q1_float(spark, folder, out):
    return auctions.q1_float(_bid(spark, folder))


@stream_query
def stream_q2_modulo(spark, folder, out):
    return auctions.q2_modulo(_bid(spark, folder))


@stream_query
def stream_q1(spark, folder, out):
    return auctions.q1(_bid(spark, folder))


@stream_query
def stream_q2(spark, folder, out):
    """JSON records in files, through the topic scan."""
    path = jobs.publish(mapped.bid_records(spark, folder), out)
    records = topics.file_records(spark, path, stream=True, file_format="parquet")
    criteria = TopicCriteria(selections=(Selection("auction", HOT_AUCTIONS),), projections=("auction", "price"))
    return scan_topic(records, topic_schema("bid", "ltz"), criteria, on_malformed="drop")


def _as_records(topic, rows):
    """Rows as JSON records of a topic."""
    made = sinks.keyed_records(rows, topic).withColumn("topic", F.lit(topic))
    return made.select(*[
        F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in topics.RECORD_SCHEMA])


def _over_topics(name, parameters):
    def run(spark, folder, out):
        windowed = name not in ("q1", "q3")  # these hold nothing back that a closing row would let go
        rows = {n: MAPPED[n](spark, folder) for n in pushdown.NEEDS[name]}
        made = publish_in_order(rows, out, closing=windowed, encode=_as_records)
        records = {n: topic.stream(spark) for n, topic in made.items()}
        return pushdown.over_topics(name, records, on_malformed="drop", **parameters)

    run.__name__ = f"stream_pushed_{name}"
    return run


for _name in ("q1", "q3", "q5", "q8", "q11"):
    stream_query(_over_topics(_name, catalog.OVER_TOPICS[_name]))


@stream_query
def stream_q3(spark, folder, out):
    return auctions.q3(_auction(spark, folder), _person(spark, folder, out), hot=_hot(spark, folder))


@stream_query
def stream_q3_incremental(spark, folder, out):
    auction, person = _in_order(spark, folder, out, "auction", "person", closing=False)
    return emit_once_stream(auction, person.where(F.col("state").isin(*auctions.LOCAL_STATES)), hot=_hot(spark, folder))


@stream_query
def stream_q3_versions(spark, folder, out):
    auction, person = _in_order(
        spark, folder, out, "auction", "person", closing=False, person=catalog.person_versions(spark, folder))
    local = person.where(F.col("state").isin(*auctions.LOCAL_STATES, "WA"))
    return emit_once_stream(auction, local, key_type="string", hot=_hot(spark, folder))


@stream_query
def stream_q5(spark, folder, out):
    return auctions.q5(_in_order(spark, folder, out, "bid"), **catalog.HOP)


@stream_query
def stream_q5_counts(spark, folder, out):
    return auctions.q5_counts(_in_order(spark, folder, out, "bid"), **catalog.COUNT_HOP)


@stream_query
def stream_q5_counts_monotonic(spark, folder, out):
    """The same under the monotonic watermark: no delay, since the topic is in order."""
    return auctions.q5_counts(_in_order(spark, folder, out, "bid", watermark="0 seconds"), **catalog.COUNT_HOP)


@stream_query
def stream_q5_strkey(spark, folder, out):
    return auctions.q5_counts(_in_order(spark, folder, out, "bid"), key_type="string", **catalog.HOP)


@stream_query
def stream_q8(spark, folder, out):
    person, auction = _in_order(spark, folder, out, "person", "auction")
    return auctions.q8(person, auction, size=catalog.TUMBLE)


@stream_query
def stream_q8_pairs(spark, folder, out):
    person, auction = _in_order(spark, folder, out, "person", "auction", closing=False)
    return auctions.q8_pairs(person, auction, size=catalog.TUMBLE, hot=_hot(spark, folder))


@stream_query
def stream_q11(spark, folder, out):
    return auctions.q11(_in_order(spark, folder, out, "bid"), gap=catalog.GAP)


@stream_query
def stream_q11_composite(spark, folder, out):
    return auctions.q11_composite(_in_order(spark, folder, out, "bid"), gap=catalog.GAP)


@stream_query
def stream_q11_early(spark, folder, out):
    bid = _in_order(spark, folder, out, "bid", watermark=None)
    return early_sessions_stream(bid, gap=catalog.GAP, every=catalog.FIRE_EVERY, delay=WATERMARK_DELAY)


@stream_query
def stream_wordcount_running(spark, folder, out):
    words = wordcount.word_rows(_stored(spark, folder, "documents"))
    return running_count_stream(words, "word")


def stream_wordcount(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts in update mode; the last update of every word."""
    out = shared_folder(spark, "stream_wordcount")
    counts = wordcount.wordcount(_stored(stream_session(spark), folder, "documents"))
    jobs.run_updates(counts, out)
    return jobs.latest_updates(spark, out, counts.schema, ["word"])


def stream_wordcount_two_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The same over two streams, counted together."""
    out, stream = shared_folder(spark, "stream_wordcount_two_inputs"), stream_session(spark)
    counts = wordcount.wordcount_two_inputs(_stored(stream, folder, "documents"), _stored(stream, folder, "conversations"))
    jobs.run_updates(counts, out)
    return jobs.latest_updates(spark, out, counts.schema, ["word"])


CATALOG["stream_wordcount"] = stream_wordcount
CATALOG["stream_wordcount_two_inputs"] = stream_wordcount_two_inputs


def stream_scan_savings(spark: SparkSession, folder: str) -> DataFrame:
    """The totals that a scanned stream reports per micro-batch, and over how many micro-batches, summed up."""
    out, session = shared_folder(spark, "stream_scan_savings"), stream_session(spark)
    topic = publish_in_order({"bid": mapped.bid(session, folder)}, out, closing=False, encode=_as_records)["bid"]
    scanned = observed_scan(topic.stream(session), catalog.SAVINGS_CRITERIA)
    updates = reports.run_reported(session, sinks.discard_writer(scanned, f"{out}/checkpoint"))
    totals = reports.scan_reports(spark, updates)
    columns = ("records", "kept", "removed", "bytes_read", "bytes_sent")
    summed = totals.agg(*[F.sum(c).alias(c) for c in columns], (F.count("*") >= 3).alias("several_batches"))
    return summed.withColumn("bytes_saved", F.col("bytes_read") - F.col("bytes_sent"))


def stream_latency(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a latency sink reports per micro-batch, summed up; ages depend on the clock and are only ordered."""
    out, session = shared_folder(spark, "stream_latency"), stream_session(spark)
    bid = _in_order(session, folder, out, "bid", closing=False)
    updates = reports.run_reported(session, sinks.discard_writer(sinks.with_latency(bid), f"{out}/checkpoint"))
    seen = reports.latency_reports(spark, updates)
    return seen.agg(F.sum("rows").alias("rows"), (F.count("*") >= 3).alias("several_batches"),
                    F.bool_and(F.col("mean_ms") <= F.col("max_ms")).alias("ordered"))


# Every so many bids come two slices late; slices are quarters of the time span.
LATE_EVERY, LATE_SLICES, LATE_WINDOW = 50, 4, "10 seconds"


def _out_of_order(spark, folder, out):
    """Bids in slices of time, of which some arrive two slices later."""
    rows = mapped.bid_from(table(spark, folder, "events"), "event_id")
    low, high = rows.agg(F.min(F.unix_micros(F.col(TIME).cast("timestamp"))), F.max(F.unix_micros(F.col(TIME).cast("timestamp")))).first()
    width = (high - low) // LATE_SLICES + 1 if low is not None else 1
    own = F.call_function("div", F.unix_micros(F.col(TIME).cast("timestamp")) - F.lit(low or 0), F.lit(width))
    arrival = F.when(F.col("event_id") % LATE_EVERY == 0, F.least(own + 2, F.lit(LATE_SLICES - 1))).otherwise(own)
    return publish_slices(rows, f"{out}/bid", arrival, LATE_SLICES, files=2)


def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The bids that lie behind the watermark when they arrive."""
    out, session = shared_folder(spark, "stream_late_rows"), stream_session(spark)
    topic = _out_of_order(session, folder, out)
    ledger = LateLedger(f"{out}/ledger", topic.schema, size=LATE_WINDOW)
    ledger.run(topic.stream(session))
    return ledger.late(spark).select("event_id", "auction", "bidder", TIME, F.col("batch").alias("slice"))


def stream_in_time_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bids per auction and window of a stream with late bids, which Spark drops: those that the ledger calls in time."""
    out, session = shared_folder(spark, "stream_in_time_counts"), stream_session(spark)
    bid = with_watermark(jobs.zoned(_out_of_order(session, folder, out).stream(session)))
    counts = auctions.q5_counts(bid, size=LATE_WINDOW, slide=LATE_WINDOW)
    jobs.run_available(counts, out)
    return jobs.written(spark, out, counts.schema)


for _run in (stream_scan_savings, stream_latency, stream_late_rows, stream_in_time_counts):
    CATALOG[_run.__name__] = _run
