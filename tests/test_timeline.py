from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sluice.functions.timing import time_slice
from sluice.operators.emit_once import emit_once
from sluice.operators.timeline import even_slices, previous_row, running_sum, version_as_of

START = datetime(2024, 1, 1)


def series(spark, n=400, seed=3):
    """One key holds a third of the rows and has long silences."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 9, n))
    minutes = np.sort(rng.choice(60 * 24 * 30, n, replace=False))
    rows = [(i, int(k), START + timedelta(minutes=int(m)), int(v))
            for i, (k, m, v) in enumerate(zip(keys, minutes, rng.integers(0, 50, n)))]
    return rows, spark.createDataFrame(rows, "id bigint, key bigint, at timestamp_ntz, v bigint")


def test_running_sum(spark):
    rows, df = series(spark)
    sums, want = {}, {}
    for i, key, _, v in rows:
        sums[key] = sums.get(key, 0) + v
        want[i] = sums[key]
    for span in (None, time_slice("_slice", "2 days")):
        summed = running_sum(df, ["key"], ["at"], time_slice("at", "6 hours"), F.col("v"), "total", span_by=span)
        assert summed.columns == [*df.columns, "total"]
        assert {r.id: r.total for r in summed.collect()} == want


def test_previous_row(spark):
    rows, df = series(spark)
    looked = previous_row(df, ["key"], ["at"], time_slice("at", "6 hours"), {"before": "v", "when": "at"})
    got = {r.id: (r.before, r.when) for r in looked.collect()}
    last, want = {}, {}
    for i, key, at, v in rows:
        want[i] = last.get(key, (None, None))
        last[key] = (v, at)
    assert got == want


def test_version_as_of(spark):
    rows, df = series(spark)
    asked = df.where("id % 3 <> 0").select("id", "key", "at")
    versions = df.where("id % 3 = 0 and key <> 5").select("key", "at", F.struct("v").alias("version"))
    got = {r.id: (r.known and r.known.v, r.first and r.first.v) for r in version_as_of(
        asked, versions, ["key"], "at", lambda t: time_slice(t, "6 hours"), "known", "first"
    ).collect()}
    want = {}
    for i, key, at, _ in rows:
        if i % 3:
            line = [(t, v) for j, k, t, v in rows if k == key and j % 3 == 0 and k != 5]
            before = [v for t, v in line if t <= at]
            want[i] = (before[-1] if before else None, line[0][1] if line else None)
    assert got == want


PERSON = "id bigint, name string, city string, state string, dateTime timestamp_ntz"
AUCTION = "id bigint, seller bigint, dateTime timestamp_ntz"


def at(s):
    return START + timedelta(seconds=s)


def test_emit_once(spark, collected):
    persons = [(1, "ann", "x", "OR", at(10)), (1, "ann", "y", "OR", at(20)), (1, "ann", "z", "OR", at(20)),
               (2, "bob", None, "CA", at(5))]
    items = [
        (100, 1, at(1)), (100, 1, at(2)), (101, 1, at(3)),   # wait; 100 waits once
        (102, 1, at(10)), (103, 1, at(15)), (103, 1, at(16)),  # known; both copies come
        (104, 1, at(20)), (105, 1, at(99999)),                # the greatest version of the instant
        (108, 2, at(6)), (108, 2, at(6)),                     # copies of one instant come both
        (106, 2, at(5)), (107, 3, at(1)),                     # a tie goes to the person; nobody sells 107
    ]
    got = collected(emit_once(
        spark.createDataFrame(items, AUCTION), spark.createDataFrame(persons, PERSON), time_slices="10 seconds"
    ).select("id", "name", F.coalesce("city", F.lit("-")).alias("city")))
    assert got == [
        (100, "ann", "x"), (101, "ann", "x"), (102, "ann", "x"), (103, "ann", "x"), (103, "ann", "x"),
        (104, "ann", "z"), (105, "ann", "z"), (106, "bob", "-"), (108, "bob", "-"),
        (108, "bob", "-"),
    ]


def test_emit_once_does_not_depend_on_slices_or_key_type(spark, collected):
    rng = np.random.default_rng(5)
    persons = [(int(k), f"p{k}", f"c{i}", "OR", at(int(t)))
               for i, (k, t) in enumerate(zip(rng.integers(0, 6, 60), rng.integers(0, 3000, 60)))]
    items = [(int(i), int(k), at(int(t)))
             for i, k, t in zip(rng.integers(0, 150, 300), rng.integers(0, 7, 300), rng.integers(0, 3000, 300))]
    auction, person = spark.createDataFrame(items, AUCTION), spark.createDataFrame(persons, PERSON)
    results = [collected(emit_once(auction, person, time_slices=s, key_type=k))
               for s, k in (("7 seconds", "bigint"), ("1 day", "bigint"), ("100 seconds", "string"))]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) > 200


def test_slices_are_even_in_bursts_and_rise_with_time(spark):
    """Half of all rows lie in one hour of ten years, on one key; some have no time, some lie outside of the span."""
    far = [(i, 1, START + timedelta(hours=9 * i), i) for i in range(3000)]
    burst = [(3000 + i, 0, START + timedelta(days=900, milliseconds=1200 * i), i) for i in range(3000)]
    df = spark.createDataFrame(far + burst + [(9000, 0, None, 1)], "id bigint, key bigint, at timestamp_ntz, v bigint")
    slice_of = even_slices([df], "at", slices=60)
    rows = df.withColumn("s", slice_of("at")).where("at IS NOT NULL").orderBy("at", "id").collect()
    numbers = [r.s for r in rows]
    assert numbers == sorted(numbers) and len(set(numbers)) <= 200
    counts = {}
    for r in rows:
        counts[r.key, r.s] = counts.get((r.key, r.s), 0) + 1
    assert max(counts.values()) <= 2 * 6000 / 60
    beyond = spark.createDataFrame([(START - timedelta(days=1),), (START + timedelta(days=9000),)], "at timestamp_ntz")
    assert [r.s for r in beyond.select(slice_of("at").alias("s")).collect()] == [0, numbers[-1]]
    assert even_slices([df.where("id < 0")], "at")("at") is not None


def test_previous_row_by_time_and_number_over_even_slices(spark):
    """Ties of the time are told apart by a number, with negative ones and times before 1970; no sort aggregate."""
    rng = np.random.default_rng(9)
    rows = [(int(i), int(k), datetime(1969, 12, 31, 23, 59) + timedelta(seconds=int(t)), int(v))
            for i, k, t, v in zip(rng.permutation(500) - 250, rng.integers(0, 3, 500), rng.integers(0, 120, 500), rng.integers(0, 99, 500))]
    df = spark.createDataFrame(rows, "id bigint, key bigint, at timestamp_ntz, v bigint")
    looked = previous_row(df, ["key"], ["at", "id"], even_slices([df], "at", slices=9)("at"), {"before": "v"})
    want, last = {}, {}
    for i, key, at_, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last.get(key)
        last[key] = v
    assert {r.id: r.before for r in looked.collect()} == want
    assert "SortAggregate" not in looked._jdf.queryExecution().executedPlan().toString()
