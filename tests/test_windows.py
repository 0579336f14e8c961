from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import windows
from sluice.operators.windows import count_up, early_firings, hop_counts, session_counts
from sluice.plans import auctions

START = datetime(2024, 1, 1)


def frame(spark, stamps, key="k"):
    rows = [(key, START + timedelta(seconds=s)) for s in stamps]
    return spark.createDataFrame(rows, "key string, at timestamp_ntz")


def test_session_gap_is_inclusive(spark, collected):
    df = frame(spark, [0, 10, 20.001, 30.002, 45])
    got = [(r[1], r[2], r[3]) for r in collected(session_counts(df, ["key"], "at", "10 seconds"))]
    at = lambda s: START + timedelta(seconds=s)
    assert got == [(at(0), at(20), 2), (at(20.001), at(30.001), 1), (at(30.002), at(40.002), 1), (at(45), at(55), 1)]


def test_session_equals_builtin_sessions(spark, collected):
    stamps = [(i * i * 7919) % 4000 / 3 for i in range(300)]
    df = frame(spark, stamps).unionByName(frame(spark, stamps[:50], "hot"))
    builtin = df.groupBy("key", F.session_window("at", "10 seconds").alias("s")).agg(F.count("*").alias("num"))
    want = collected(builtin.select("key", "s.start", "s.end", "num"))
    assert collected(session_counts(df, ["key"], "at", "10 seconds")) == want


def test_sessions_over_many_slices(spark, collected, monkeypatch):
    """Slices of two gaps: sessions that end in a slice, span several, or lie at their borders; two keys and a null."""
    monkeypatch.setattr(windows, "SLICE_GRAINS", 2)
    stamps = [0, 4, 9, 19, 20, 29.9, 39.9, 49, 58, 68, 79, 100, 111, 120, 121, 131.5, 400, 410, 420, 430, 440, 450, 460]
    df = frame(spark, stamps).unionByName(frame(spark, stamps[::2], "hot")).unionByName(frame(spark, stamps[1::3], None))
    builtin = df.groupBy("key", F.session_window("at", "10.000001 seconds").alias("s")).agg(F.count("*").alias("num"))
    ends = F.col("s.end") - F.expr("INTERVAL '0.000001' SECOND")
    order = lambda rows: sorted(rows, key=repr)
    want = order(tuple(r) for r in builtin.select("key", "s.start", ends.alias("e"), "num").collect())
    assert order(tuple(r) for r in session_counts(df, ["key"], "at", "10 seconds").collect()) == want


def test_rows_without_time_belong_to_no_session(spark):
    df = frame(spark, [1]).unionByName(spark.createDataFrame([("k", None)], "key string, at timestamp_ntz"))
    assert session_counts(df, ["key"], "at", "10 seconds").first().num == 1


@pytest.mark.parametrize("size, slide", [("10 seconds", "2 seconds"), ("10 seconds", "3 seconds"), ("4 seconds", "4 seconds"),
                                         ("10 seconds", "4 seconds"), ("1500 milliseconds", "600 milliseconds")])
def test_hops_equal_builtin_windows(spark, collected, size, slide):
    df = frame(spark, [0, 0.5, 1.999999, 2, 9.9, 10, 33])
    builtin = df.groupBy(F.window("at", size, slide).alias("w"), "key").agg(F.count("*").alias("num"))
    assert collected(hop_counts(df, ["key"], "at", size, slide)) == collected(builtin.select("w", "key", "num"))


@pytest.mark.parametrize("count, counts", [(1, [1]), (2, [2]), (3, [3, 3]), (7, [3, 6, 7])])
def test_early_firings(spark, count, counts):
    df = spark.createDataFrame([(count,)], "num bigint")
    assert sorted(r.num for r in early_firings(df, 3).collect()) == counts


def test_count_up_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 3)
    df = spark.createDataFrame([(1, 1, 1), (2, 5, 13)], "i int, low bigint, high bigint")
    got = sorted((r.i, r.n) for r in count_up(df, F.col("low"), F.col("high"), "n").collect())
    assert got == [(1, 1)] + [(2, n) for n in range(5, 14)]


def test_hot_items_keep_ties(spark, collected):
    bids = [(1, 0), (1, 1), (2, 0), (2, 1), (3, 1)]
    df = spark.createDataFrame(
        [(a, START + timedelta(seconds=s)) for a, s in bids], "auction bigint, dateTime timestamp_ntz"
    )
    got = collected(auctions.q5(df, size="2 seconds", slide="2 seconds"))
    assert got == [(1, 2), (2, 2)]


def test_session_key_is_the_group_key(spark, collected):
    df = spark.createDataFrame(
        [(7, 1, START), (8, 1, START + timedelta(seconds=1))], "auction bigint, bidder bigint, dateTime timestamp_ntz"
    )
    assert collected(auctions.q11_early(df)) == [(1, 2)]
