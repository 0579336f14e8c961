import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans import auctions
from sluice.schemas import result_schema, topic_schema
from sluice.session import shared_folder, stream_session
from sluice.sources import replay, results, sinks, topics
from sluice.streaming import jobs

BID = {"auction": 1, "bidder": 2, "price": 300, "dateTime": "2024-01-01 00:00:01.250", "extra": "e"}


def records(spark, values):
    return spark.createDataFrame([("bid", 0, i, None, v) for i, v in enumerate(values)], topics.RECORD_SCHEMA)


def test_typed_topic(spark):
    df = topics.typed_topic(records(spark, [json.dumps(BID), None]), "bid")
    assert df.schema == topic_schema("bid")
    assert [tuple(r) for r in df.collect()] == [(1, 2, 300, datetime(2024, 1, 1, 0, 0, 1, 250000), "e")]


def test_epoch_millis(spark):
    value = json.dumps({**BID, "dateTime": 1704067201250})
    row = topics.typed_topic(records(spark, [value]), "bid", epoch_millis=True).first()
    assert row.dateTime == datetime(2024, 1, 1, 0, 0, 1, 250000)


def test_round_trip_through_keyed_records(spark):
    rows = topics.typed_topic(records(spark, [json.dumps(BID)]), "bid")
    record = sinks.keyed_records(rows, "bid").first()
    assert record.key == "1"
    assert json.loads(record.value) == {**BID, "dateTime": "2024-01-01 00:00:01.250000"}
    assert json.loads(sinks.json_records(rows).first().value)["extra"] == "e"


def test_start_positions(spark, folder):
    with pytest.raises(ValueError):
        topics.file_records(spark, folder, start="middle")
    with pytest.raises(ValueError):
        topics.kafka_records(spark, "nowhere:1", "bid", start="middle")
    with pytest.raises(ValueError):
        topics.kafka_records(spark, "nowhere:1", "bid", stream=False, start="latest")
    records(spark, [json.dumps(BID)]).write.json(f"{folder}/topic")
    assert topics.file_records(spark, f"{folder}/topic").count() == 1


def test_conform_goes_by_position(spark):
    df = spark.createDataFrame([(1, "n", datetime(2024, 1, 1))], "a int, b string, starttime timestamp_ntz")
    shaped = sinks.conform(df, result_schema("q8"))
    assert shaped.schema == result_schema("q8")
    with pytest.raises(ValueError):
        sinks.conform(df, result_schema("q2"))


def test_euro_price_type(spark):
    df = topics.typed_topic(records(spark, [json.dumps(BID)]), "bid")
    row = auctions.q1(df).first()
    assert row.price == Decimal("272.400")
    assert auctions.q1(df).schema["price"].dataType == T.DecimalType(23, 3)


def test_float_price_is_cut_off(spark):
    df = spark.createDataFrame([(1, 2, p, datetime(2024, 1, 1)) for p in (1, 99, 100, -7)],
                               "auction bigint, bidder bigint, price bigint, dateTime timestamp_ntz")
    assert [r.price for r in auctions.q1_float(df).collect()] == [0, 81, 82, -5]


def test_event_mix(spark):
    df = spark.range(100).select(F.col("id").alias("n"))
    parts = replay.split_mix(df, "n")
    assert {t: p.count() for t, p in parts.items()} == {"person": 2, "auction": 6, "bid": 92}


def test_results_round_trip(spark, folder):
    schema = result_schema("q5")
    df = spark.createDataFrame([(1, 2), (3, 4)], schema)
    results.write_results(df, f"{folder}/out")
    assert sorted(tuple(r) for r in results.read_results(spark, f"{folder}/out", schema).collect()) == [(1, 2), (3, 4)]


def test_spread(spark):
    assert sinks.spread(spark.range(100), 7).rdd.getNumPartitions() == 7


def test_replay_of_files(spark, folder):
    spark.range(30).repartition(3).write.parquet(f"{folder}/in")
    stream = stream_session(spark)
    schema = T.StructType().add("id", T.LongType())
    df = replay.replay_files(stream, f"{folder}/in", schema)
    query = (df.writeStream.format("parquet").option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    assert len(query.recentProgress) == 3
    assert stream.read.parquet(f"{folder}/rows").count() == 30


def test_latency_report(spark, folder):
    spark.createDataFrame([(1, datetime(2024, 1, 1))], "v int, dateTime timestamp").write.parquet(f"{folder}/in")
    stream = stream_session(spark)
    schema = T.StructType().add("v", T.IntegerType()).add("dateTime", T.TimestampType())
    timed = sinks.with_latency(stream.readStream.schema(schema).parquet(f"{folder}/in"))
    query = sinks.discard_writer(timed, f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    (report,) = sinks.latency_rows(query.recentProgress)
    assert report["rows"] == 1 and report["max_ms"] == report["mean_ms"] > 0


def test_shared_folders_are_new_and_follow_the_setting(spark):
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or one.startswith(base)


def test_zone_changes(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert jobs.zoned(df).schema["t"].dataType == T.TimestampType()
    assert jobs.zoneless(jobs.zoned(df)).collect() == df.collect()
