"""Streams over small files, one per trigger; every stream equals its batch twin on the rows the watermark closed."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators.scan import Selection, TopicCriteria, carries_time, observed_scan, scan_topic
from sluice.plans import auctions, pushdown, wordcount
from sluice.schemas import topic_schema
from sluice.session import stream_session
from sluice.sources import sinks, topics
from sluice.streaming import jobs, reports
from sluice.streaming.early_sessions import EarlySessions, early_sessions_stream, firings
from sluice.streaming.emit_once import emit_once_stream
from sluice.streaming.late import LateLedger
from sluice.streaming.publisher import publish_in_order, publish_slices
from sluice.streaming.running_count import running_count_stream

START = datetime(2024, 1, 1)


def at(s):
    return START + timedelta(seconds=float(s))


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Topic:
    """A folder of JSON record files whose modification times give their order."""

    def __init__(self, spark, folder, name):
        self.spark, self.path, self.name, self.files = spark, f"{folder}/{name}", name, 0
        os.makedirs(self.path)

    def add(self, rows):
        df = self.spark.createDataFrame(rows, topic_schema(self.name, "ntz"))
        lines = [
            row.json for row in sinks.keyed_records(df, self.name).select(
                F.to_json(F.struct(F.lit(self.name).alias("topic"), F.lit(0).alias("partition"),
                                   F.lit(self.files).cast("bigint").alias("offset"), "key", "value")).alias("json")
            ).collect()
        ]
        file = f"{self.path}/part-{self.files:04d}.json"
        with open(file, "w") as out:
            out.write("\n".join(lines))
        os.utime(file, (1_700_000_000 + self.files * 10,) * 2)
        self.files += 1
        return self

    def batch(self):
        return topics.typed_topic(topics.file_records(self.spark, self.path), self.name)

    def stream(self, files_per_trigger=1, watermark=topics.WATERMARK_DELAY):
        records = topics.file_records(
            stream_session(self.spark), self.path, stream=True, files_per_trigger=files_per_trigger
        )
        return topics.typed_topic(records, self.name, watermark=watermark)


def bid(auction, bidder, s, price=100, extra="e"):
    return auction, bidder, price, at(s), extra


def item(id, seller, s, category=10, reserve=5):
    return id, "n", "d", 1, reserve, at(s + 999), seller, category, at(s), "e"


def person(id, s, name="p", city="c", state="OR"):
    return id, name, "m", "cc", city, state, at(s), "e"


def run(df, folder, name="out"):
    out = f"{folder}/{name}"
    jobs.run_available(df, out)
    return jobs.zoneless(jobs.written(df.sparkSession, out, df.schema))


SENTINEL = 100_000


@pytest.fixture
def bids(spark, folder):
    rng = np.random.default_rng(1)
    topic = Topic(spark, folder, "bid")
    for part in range(3):
        seconds = np.sort(rng.choice(np.arange(0, 40_000, 250), 60, replace=False)) / 1000 + part * 40
        topic.add([bid(int(a), int(b), s) for a, b, s in zip(rng.integers(1, 5, 60), rng.integers(1, 4, 60), seconds)])
    return topic.add([bid(0, 0, SENTINEL)])


def test_stateless_queries(bids, folder, collected):
    for name in ("q0", "q1", "q2_modulo"):
        plan = getattr(auctions, name)
        assert collected(run(plan(bids.stream()), folder, name)) == collected(plan(bids.batch()))


def test_hot_items(bids, folder, collected):
    want = collected(auctions.q5(bids.batch().where("auction > 0")))
    assert want and collected(run(auctions.q5(bids.stream()), folder)) == want


def test_hop_counts(bids, folder, collected):
    size = {"size": "20 seconds", "slide": "5 seconds"}
    want = collected(auctions.q5_counts(bids.batch().where("auction > 0"), **size))
    assert collected(run(auctions.q5_counts(bids.stream(), **size), folder)) == want


def test_sessions(bids, folder, collected):
    want = collected(auctions.q11(bids.batch().where("bidder > 0"), gap="1 second"))
    assert len(want) > 10
    assert collected(run(auctions.q11(bids.stream(), gap="1 second"), folder)) == want
    composite = collected(auctions.q11_composite(bids.batch().where("bidder > 0"), gap="1 second"))
    assert collected(run(auctions.q11_composite(bids.stream(), gap="1 second"), folder, "composite")) == composite


def test_session_gap_is_inclusive_on_streams(spark, folder, collected):
    topic = Topic(spark, folder, "bid").add([bid(1, 1, 0), bid(1, 1, 10), bid(1, 1, 20.001)]).add([bid(0, 0, SENTINEL)])
    got = collected(run(auctions.q11(topic.stream()), folder))
    assert got == [(1, 1, at(20.001), at(30.001)), (1, 2, at(0), at(20))]


@pytest.fixture
def sales(spark, folder):
    rng = np.random.default_rng(2)
    people, items = Topic(spark, folder, "person"), Topic(spark, folder, "auction")
    for part in range(3):
        low = part * 40
        people.add([person(part * 5 + k, low + k * 3, name=f"p{k}", state="OR" if k % 2 else "NY") for k in range(5)])
        items.add([item(part * 100 + i, int(s), low + i, int(c)) for i, (s, c) in enumerate(
            zip(rng.integers(0, 15, 35), rng.integers(9, 12, 35)))])
    people.add([person(-1, SENTINEL)])
    items.add([item(-1, -2, SENTINEL)])
    return people, items


def test_joins(sales, folder, collected):
    people, items = sales
    want = collected(auctions.q3(items.batch(), people.batch()))
    assert want and collected(run(auctions.q3(items.stream(), people.stream()), folder, "q3")) == want
    for name in ("q8", "q8_pairs"):
        plan = getattr(auctions, name)
        want = collected(plan(people.batch(), items.batch()))
        assert want and collected(run(plan(people.stream(), items.stream()), folder, name)) == want


def test_emit_once(sales, folder, collected):
    people, items = sales
    local = lambda df: df.where(F.col("state") == "OR")
    want = collected(auctions.q3_incremental(items.batch(), people.batch(), states=("OR",)))
    for salts, key_type in ((1, "bigint"), (5, "string")):
        # All files in one trigger: then event time decides the order, as in batch.
        stream = emit_once_stream(
            items.stream(100), local(people.stream(100)), salts=salts, key_type=key_type
        )
        assert want and collected(run(stream, folder, f"once{salts}")) == want


def test_emit_once_by_arrival_and_after_a_restart(spark, folder, collected):
    people, items = Topic(spark, folder, "person"), Topic(spark, folder, "auction")
    out = f"{folder}/out"

    def go_on():
        df = emit_once_stream(items.stream(100), people.stream(100), salts=3)
        jobs.run_available(df, out)
        return [(r.id, r.city) for r in sorted(jobs.written(df.sparkSession, out, df.schema).collect())]

    items.add([item(1, 7, 0), item(1, 7, 1), item(2, 7, 2), item(3, 8, 2)])
    people.add([person(9, 0)])
    assert go_on() == []
    people.add([person(7, 50, city="a")])
    assert sorted(go_on()) == [(1, "a"), (2, "a")]
    items.add([item(4, 7, 60), item(4, 7, 61)])
    people.add([person(7, 70, city="b"), person(8, 70, city="z")])
    assert sorted(go_on()) == [(1, "a"), (2, "a"), (3, "z"), (4, "a"), (4, "a")]
    items.add([item(5, 7, 80)])
    assert sorted(go_on())[-1] == (5, "b")


def test_firings():
    assert firings(0, 0, 7, 3) == ([3, 6], 1)
    assert firings(6, 0, 2, 3) == ([], 2)
    assert firings(8, 2, 1, 3) == ([9], 0)
    # Sessions that merged hold more than one threshold's worth: the next row reports.
    assert firings(10, 5, 4, 3) == ([11, 14], 0)
    assert firings(5, 2, 0, 3) == ([], 2)


def test_early_sessions(bids, folder, collected):
    want = collected(auctions.q11_early(bids.batch().where("bidder > 0"), gap="1 second", every=3))
    got = run(early_sessions_stream(bids.stream(watermark=None), gap="1 second", every=3), folder)
    assert len(want) > 10 and collected(got) == want


def test_early_sessions_after_a_restart(spark, folder, collected):
    topic, out = Topic(spark, folder, "bid"), f"{folder}/out"

    def go_on():
        df = early_sessions_stream(topic.stream(watermark=None), gap="10 seconds", every=2)
        jobs.run_available(df, out)
        return collected(jobs.written(df.sparkSession, out, df.schema))

    topic.add([bid(1, 1, 0), bid(1, 1, 5), bid(1, 1, 9)])
    assert go_on() == [(1, 2)]
    topic.add([bid(1, 1, 12), bid(1, 1, 30)])
    assert go_on() == [(1, 2), (1, 4), (1, 4)]  # the bid at 30 lets the watermark pass the end at 22
    topic.add([bid(0, 0, SENTINEL)])
    assert go_on() == [(1, 1), (1, 2), (1, 4), (1, 4)]


def test_late_sessions_merge(spark, folder, collected):
    """A bid within the delay joins two open sessions."""
    topic = Topic(spark, folder, "bid")
    topic.add([bid(1, 1, 0), bid(1, 1, 16)]).add([bid(1, 1, 8), bid(0, 0, 14)]).add([bid(0, 0, SENTINEL)])
    got = run(early_sessions_stream(topic.stream(watermark=None), gap="10 seconds", every=100, delay="20 seconds"), folder)
    assert collected(got.where("bidder = 1")) == [(1, 3)]


def test_bids_between_two_open_sessions(spark, folder, collected):
    """The bid at 10 makes the fourth of the first session, the one at 13 joins both and makes the eighth."""
    topic, out = Topic(spark, folder, "bid"), f"{folder}/out"

    def go_on():
        df = early_sessions_stream(topic.stream(watermark=None), gap="5 seconds", every=2, delay="60 seconds")
        jobs.run_available(df, out)
        return collected(jobs.written(df.sparkSession, out, df.schema))

    topic.add([bid(1, 1, t) for t in (0, 3, 5, 17, 18, 20)])
    assert go_on() == [(1, 2), (1, 2)]
    topic.add([bid(1, 1, 10), bid(1, 1, 13)])
    assert go_on() == [(1, 2), (1, 2), (1, 4), (1, 8)]


def test_sessions_of_one_key_take_linear_time():
    from time import perf_counter
    from types import SimpleNamespace

    processor = EarlySessions("bidder", 5, 2)
    processor.open = SimpleNamespace(
        iterator=lambda: iter(()), updateValue=lambda key, value: None, removeKey=lambda key: None)
    processor.handle = SimpleNamespace(registerTimer=lambda at: None, deleteTimer=lambda at: None)
    start = perf_counter()
    rows = [{"first": 100 * i, "last": 100 * i, "num": 1, "steps": b"\0"} for i in range(8000)]
    assert list(processor.handleInputRows((1,), iter(rows), None)) == []
    assert perf_counter() - start < 0.5


def _row_by_row(rows, gap, every, sessions):
    """Counts reported while instants join sessions one by one; ``sessions`` is changed."""
    out = []
    for at_ in sorted(rows):
        held = [s for s in sessions if s[0] - gap <= at_ <= s[1] + gap]
        counts, since = firings(sum(s[2] for s in held), sum(s[3] for s in held), 1, every)
        out += counts
        first, last = min([at_, *(s[0] for s in held)]), max([at_, *(s[1] for s in held)])
        sessions[:] = [s for s in sessions if s not in held] + [(first, last, sum(s[2] for s in held) + 1, since)]
    return out


def test_pieces_report_what_single_rows_report():
    """Several micro-batches whose rows fall before, between and after open sessions."""
    from types import SimpleNamespace

    from sluice.streaming.precombine import _packed

    for seed in range(60):
        rng = np.random.default_rng(seed)
        gap, every, state = 10, int(rng.integers(1, 5)), {}
        processor = EarlySessions("bidder", gap, every)
        processor.open = SimpleNamespace(
            iterator=lambda: iter([((k,), v) for k, v in state.items()]),
            updateValue=lambda key, value: state.__setitem__(key[0], value), removeKey=lambda key: state.pop(key[0]))
        processor.handle = SimpleNamespace(registerTimer=lambda at: None, deleteTimer=lambda at: None)
        sessions = []
        for _ in range(4):
            rows = rng.integers(0, 150, int(rng.integers(0, 25))).tolist()
            task = rng.integers(0, 2, len(rows))
            pieces = {}
            for t, k in zip(rows, task):
                pieces.setdefault((int(k), t // gap), []).append(t)
            combined = [{"first": min(p), "last": max(p), "num": len(p), "steps": _packed(np.sort(np.array(p, np.int64)))}
                        for p in pieces.values()]
            got = [c for r in processor.handleInputRows((1,), iter(combined), None)
                   for c in range(r["low"], r["high"] + 1, r["step"])]
            assert got == _row_by_row(rows, gap, every, sessions), (seed, rows)
            assert sorted((k, *v) for k, v in state.items()) == sorted(sessions)


def test_pieces_of_a_hot_key_are_few_and_unpack(spark):
    from sluice.streaming.precombine import combine_pieces, instants

    micros = [0, 0, 7, 300, 299_999, 300_000, 10_000_000, -5, -1]
    rows = [(None if i % 2 else 7, START + timedelta(microseconds=m)) for i in range(40) for m in micros]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp")).coalesce(1)
    made = combine_pieces(df, "k", "at", 300_000).collect()
    assert len(made) == 2 * 4
    base = spark.sql("SELECT unix_micros(TIMESTAMP '2024-01-01 00:00:00')").first()[0]
    for key in (None, 7):
        back = instants([(r["first"], r["num"], r["steps"]) for r in made if r["k"] == key])
        assert back == [(base + m, 20 * micros.count(m)) for m in sorted(set(micros))]


def test_topics_in_order_take_several_batches_and_lose_nothing(spark, folder, collected):
    """Two topics cut at the same instants; one lacks rows in most slices, instants repeat, rows have no time."""
    session = stream_session(spark)
    rng = np.random.default_rng(8)
    bids = [bid(int(rng.integers(1, 5)), int(rng.integers(1, 4)), float(s)) for s in rng.integers(0, 400, 900)]
    shuffled = session.createDataFrame([bids[i] for i in rng.permutation(len(bids))], topic_schema("bid", "ntz")).repartition(5)
    few = session.createDataFrame([person(i, 390 + i) for i in range(3)] + [(9, "n", "m", "cc", "c", "OR", None, "e")],
                                  topic_schema("person", "ntz"))
    made = publish_in_order({"bid": shuffled, "person": few}, folder, slices=5, files=3)
    assert made["bid"].slices >= 4 and made["bid"].files == 3
    stream = topics.with_watermark(jobs.zoned(made["bid"].stream(session)))
    counts = auctions.q5_counts(stream, size="10 seconds", slide="10 seconds")
    out = f"{folder}/out"
    updates = reports.run_reported(session, counts.writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/checkpoint"))
    seen = reports.batch_reports(spark, updates).collect()
    assert sum(r.input_rows > 0 for r in seen) == made["bid"].slices + 1 and not any(r.dropped_rows for r in seen)
    want = collected(auctions.q5_counts(shuffled, size="10 seconds", slide="10 seconds"))
    assert collected(jobs.written(spark, out, counts.schema)) == want
    people = run(made["person"].stream(session).where("id >= 0"), folder, "people")
    assert collected(people.select("id")) == [(0,), (1,), (2,), (9,)]
    # A rate: no trigger takes many more rows than asked for.
    paced = publish_in_order({"bid": shuffled}, f"{folder}/paced", rows_per_slice=200, files=1, closing=False)["bid"]
    query = sinks.discard_writer(paced.stream(session), f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert len(sizes) == 5 and max(sizes) <= 220 and sum(sizes) == 900 + 5


def test_ledger_keeps_what_spark_drops(spark, folder, collected):
    session = stream_session(spark)
    slices = [[bid(1, 1, 0), bid(1, 1, 100)], [bid(2, 1, 101)], [bid(1, 1, 3), bid(3, 1, 5), bid(2, 1, 102)], [bid(4, 1, 99)]]
    rows = session.createDataFrame([(*r, i) for i, part in enumerate(slices) for r in part],
                                   f"{topic_schema('bid', 'ntz').simpleString()[7:-1].replace(':', ' ')}, part int")
    topic = publish_slices(rows, f"{folder}/bid", F.col("part"), len(slices), files=2)
    ledger = LateLedger(f"{folder}/ledger", topic.schema, size="10 seconds")
    ledger.run(topic.stream(session))
    ledger.run(topic.stream(session))  # nothing new
    assert collected(ledger.late(spark).select("auction", "batch")) == [(1, 2), (3, 2)]
    both = ledger.in_time(spark).count() + ledger.late(spark).count()
    assert both == 7 + 1  # the closing row
    counts = auctions.q5_counts(topics.with_watermark(jobs.zoned(topic.stream(session))), size="10 seconds", slide="10 seconds")
    updates = reports.run_reported(session, counts.writeStream.format("parquet").option("path", f"{folder}/out/rows").option(
        "checkpointLocation", f"{folder}/out/checkpoint"))
    dropped = reports.batch_reports(spark, updates).agg(F.sum("dropped_rows")).first()[0]
    assert dropped == ledger.late(spark).count() == 2
    want = collected(auctions.q5_counts(ledger.in_time(spark).where("auction > 0"), size="10 seconds", slide="10 seconds"))
    assert collected(jobs.written(spark, f"{folder}/out", counts.schema)) == want


def test_emit_once_over_slices_keeps_ids_a_set(spark, folder, collected):
    """In the order of time over several micro-batches: as in batch, though ids wait and repeat over all of them."""
    session = stream_session(spark)
    rng = np.random.default_rng(11)
    items_ = session.createDataFrame(
        [item(int(i), int(k), float(s)) for i, k, s in zip(rng.integers(0, 60, 400), rng.integers(0, 6, 400), rng.integers(0, 300, 400))],
        topic_schema("auction", "ntz"))
    people_ = session.createDataFrame([person(k, 50 * k + v, city=f"c{v}") for k in range(5) for v in (9, 140)], topic_schema("person", "ntz"))
    made = publish_in_order({"auction": items_, "person": people_}, folder, slices=6, files=2, closing=False)
    auction, people = (topics.with_watermark(jobs.zoned(t.stream(session))) for t in made.values())
    df = emit_once_stream(auction, people, salts=3)
    out = f"{folder}/out"
    updates = jobs.run_available(df, out)
    assert sum(u.numInputRows > 0 for u in updates) >= 5
    want = collected(auctions.q3_incremental(items_, people_, states=("OR",)))
    assert want and collected(jobs.written(spark, out, df.schema)) == want


def test_late_rows_are_dropped_and_counted(spark, folder, collected):
    """A watermark takes effect on late rows one micro-batch after it was computed."""
    topic = Topic(spark, folder, "bid").add([bid(1, 1, 0), bid(1, 1, 100)]).add([bid(2, 1, 101)])
    topic.add([bid(1, 1, 3), bid(2, 1, 102)]).add([bid(0, 0, SENTINEL)])
    counts = auctions.q5_counts(topic.stream(), size="10 seconds", slide="10 seconds")
    out = f"{folder}/out"
    query = (counts.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/c")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators) == 1
    assert collected(jobs.written(counts.sparkSession, out, counts.schema)) == [(1, 1), (1, 1), (2, 2)]


def test_scan_on_a_stream(bids, folder, collected):
    criteria = TopicCriteria(selections=(Selection("auction", (1, 2)),), projections=("auction", "dateTime"))
    records = topics.file_records(stream_session(bids.spark), bids.path, stream=True)
    scanned = scan_topic(records, topic_schema("bid", "ltz"), criteria)
    assert carries_time(criteria)
    want = collected(bids.batch().where("auction in (1, 2)").select("auction", "dateTime"))
    assert collected(run(scanned, folder)) == want
    windowed = auctions.q5_counts(scan_topic(records, topic_schema("bid", "ltz"), criteria))
    assert "EventTimeWatermark" in windowed._jdf.queryExecution().logical().toString()
    bare = TopicCriteria(projections=("auction",))
    assert not carries_time(bare)
    dropped = scan_topic(records, topic_schema("bid", "ltz"), bare)
    assert "EventTimeWatermark" not in dropped._jdf.queryExecution().logical().toString()


def test_scan_totals_of_a_stream(bids, folder):
    criteria = TopicCriteria(selections=(Selection("auction", (1, 2)),), projections=("auction",))
    records = topics.file_records(stream_session(bids.spark), bids.path, stream=True, files_per_trigger=2)
    query = sinks.discard_writer(observed_scan(records, criteria), f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    totals = [p.observedMetrics["scan"] for p in query.recentProgress if "scan" in p.observedMetrics]
    want = bids.batch().where("auction in (1, 2)").count()
    assert len(totals) == 2
    assert sum(t["records"] for t in totals) == 181 and sum(t["kept"] for t in totals) == want
    assert all(t["bytes_sent"] < t["bytes_read"] for t in totals)


def test_queries_over_topics_on_streams(bids, folder, collected):
    records = topics.file_records(stream_session(bids.spark), bids.path, stream=True, files_per_trigger=2)
    got = pushdown.over_topics("q11", {"bid": records}, gap="1 second")
    want = auctions.q11(bids.batch().where("bidder > 0"), gap="1 second")
    assert collected(run(got, folder)) == collected(want)


@pytest.fixture
def lines(spark, folder):
    path = f"{folder}/lines"
    os.makedirs(path)
    texts = ["the cat the hat", "a cat", "the end the"]
    for i, text in enumerate(texts):
        spark.createDataFrame([(text,)], "text string").coalesce(1).write.json(f"{folder}/tmp{i}")
        source = next(f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".json"))
        with open(f"{folder}/tmp{i}/{source}") as file, open(f"{path}/{i}.json", "w") as out:
            out.write(file.read())
        os.utime(f"{path}/{i}.json", (1_700_000_000 + i * 10,) * 2)
    reader = stream_session(spark).readStream.schema("text string").option("maxFilesPerTrigger", 1)
    return reader.json(path), spark.read.schema("text string").json(path)


def test_running_counts(lines, folder, collected):
    stream, batch = lines
    counted = run(running_count_stream(wordcount.word_rows(stream), "word"), folder)
    want = wordcount.wordcount(batch).select("word", F.explode(F.sequence(F.lit(1).cast("bigint"), "num")))
    assert collected(counted) == collected(want)


def test_word_count_updates(lines, folder, collected):
    stream, batch = lines
    counts = wordcount.wordcount(stream)
    jobs.run_updates(counts, f"{folder}/out")
    got = jobs.latest_updates(stream.sparkSession, f"{folder}/out", counts.schema, ["word"])
    assert collected(got) == collected(wordcount.wordcount(batch))
    assert len(os.listdir(f"{folder}/out/updates")) == 3


def test_only_hot_sellers_are_dealt_over_salts(spark, sales, folder, collected):
    """Persons of all other sellers are kept once, whatever the number of salts; results do not depend on it."""
    from sluice.operators.emit_once import hot_sellers

    people, items = sales
    many = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS seller")
    hot = hot_sellers(many)
    assert 7 in hot and len(hot) <= 100 and None not in hot
    want = collected(auctions.q8_pairs(people.batch(), items.batch()))
    for name, known in (("none", []), ("some", [3, 7])):
        stream = auctions.q8_pairs(people.stream(), items.stream(), hot=known)
        rows = jobs.run_available(stream, f"{folder}/pairs-{name}")
        assert want and collected(jobs.zoneless(jobs.written(spark, f"{folder}/pairs-{name}", stream.schema))) == want
        if not known:  # 16 persons and 106 items, each put in at most once
            assert sum(op.numRowsUpdated for p in rows for op in p.stateOperators) <= 16 + 106
    want = collected(auctions.q3_incremental(items.batch(), people.batch(), states=("OR",)))
    local = lambda df: df.where(F.col("state") == "OR")
    for key_type, known in (("bigint", []), ("string", [3, 7])):
        stream = emit_once_stream(items.stream(100), local(people.stream(100)), salts=5, hot=known, key_type=key_type)
        assert want and collected(run(stream, folder, f"hot-{key_type}")) == want


def test_many_keys_share_few_state_keys(spark, folder, collected):
    """A call of the processor per bucket and not per key, over several micro-batches and with a null key."""
    session = stream_session(spark)
    buckets = 8 * int(session.conf.get("spark.sql.shuffle.partitions"))
    rows = session.range(3000).selectExpr(
        "id % 5 AS auction", "IF(id % 700 = 0, NULL, id % 700) AS bidder", "1L AS price",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS dateTime", "'e' AS extra")
    made = publish_in_order({"bid": rows}, folder, slices=3, files=1)["bid"]
    sessions = early_sessions_stream(jobs.zoned(made.stream(session)), gap="1500 seconds", every=2)
    seen = jobs.run_available(sessions, f"{folder}/sessions")
    assert 0 < max(op.numRowsTotal for p in seen for op in p.stateOperators) <= buckets * (2 * 16 + 4)
    want = auctions.q11_early(rows, gap="1500 seconds", every=2).collect()
    got = jobs.written(spark, f"{folder}/sessions", sessions.schema).where("bidder IS NULL OR bidder >= 0").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r.bidder is None for r in got)

    counts = running_count_stream(made.stream(session).where("price > 0").select("bidder"), "bidder")
    seen = jobs.run_available(counts, f"{folder}/counts")
    assert 0 < max(op.numRowsTotal for p in seen for op in p.stateOperators) <= buckets * 2 * 16
    got = jobs.written(spark, f"{folder}/counts", counts.schema).groupBy("bidder").agg(F.sort_array(F.collect_list("num")).alias("n")).collect()
    assert len(got) == 700 and all(r.n == list(range(1, len(r.n) + 1)) for r in got) and sum(len(r.n) for r in got) == 3000


def test_sellers_windows_are_kept_once(spark, folder, collected):
    """Persons with several names or none in a window, at times without an id; one aggregate and no join keeps them."""
    people, items = Topic(spark, folder, "person"), Topic(spark, folder, "auction")
    people.add([person(1, 1, name="a"), person(1, 2, name="b"), person(1, 3, name="a"), person(2, 4, name=None),
                person(None, 5, name="n"), person(3, 6)])
    items.add([item(1, 1, 9), item(2, 1, 8), item(3, 2, 1), item(4, None, 2), item(5, 3, 12), item(6, 4, 3)])
    people.add([person(3, 25, name="c"), person(1, 26, name="b")])
    items.add([item(7, 3, 21), item(8, 1, 39)])
    people.add([person(-1, SENTINEL)])
    items.add([item(-1, -1, SENTINEL)])
    want = auctions.q8(people.batch(), items.batch()).where("id >= 0").collect()
    out = f"{folder}/out"
    df = auctions.q8(people.stream(), items.stream())
    seen = jobs.run_available(df, out)
    got = jobs.zoneless(jobs.written(df.sparkSession, out, df.schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) == 4
    assert {op.operatorName for p in seen for op in p.stateOperators} == {"stateStoreSave"}
    assert all(len(p.stateOperators) == 1 for p in seen)


def test_registered_streams_write_state_without_counting_it(spark):
    setting = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    assert stream_session(spark).conf.get(setting) == "true"
    assert stream_session(spark, count_state=False).conf.get(setting) == "false"


def test_overlapping_windows_are_added_up_from_closed_panes(spark, folder, collected):
    """Windows of any slide, bids without an auction, quiet stretches; state is a row per bucket, not one per window."""
    rng = np.random.default_rng(3)
    topic = Topic(spark, folder, "bid")
    for part in range(4):
        seconds = np.sort(rng.choice(np.arange(0, 9_000, 10), 150, replace=False)) / 100 + part * 170
        topic.add([bid(None if a == 0 else int(a), 1, s) for a, s in zip(rng.integers(0, 40, 150), seconds)])
    topic.add([bid(-1, 0, SENTINEL)])
    shown = lambda rows: sorted(map(str, map(tuple, rows)))
    for size, slide, kind in (("20 seconds", "1 second", "bigint"), ("70 seconds", "30 seconds", "string")):
        plan = lambda rows: auctions.q5_counts(rows, size=size, slide=slide, key_type=kind)  # noqa: E731, B023
        want = plan(topic.batch().where("auction > 0 OR auction IS NULL")).collect()
        df, out = plan(topic.stream()), f"{folder}/{kind}"
        seen = jobs.run_available(df, out)
        assert shown(jobs.written(df.sparkSession, out, df.schema).collect()) == shown(want)
        buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        panes = {p.batchId: min(op.numRowsUpdated for op in p.stateOperators) for p in seen}
        assert max(panes.values()) <= buckets
        names = {op.operatorName for p in seen for op in p.stateOperators}
        assert names == {"transformWithStateInPandasExec", "stateStoreSave"}
