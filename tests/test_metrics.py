from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.plans import metrics

START = datetime(2024, 1, 1)
SCHEMA = ("run_id int, query int, parallelism int, throughput int, variant string, service string, replica int, "
          "metric string, ts timestamp_ntz, value double")


def at(s):
    return START + timedelta(seconds=s)


def sample(run=1, query=1, variant="plain", service="taskmanager", replica=1, metric="cpu_rate", s=0, value=1.0):
    return (run, query, 1, 5000, variant, service, replica, metric, at(s), value)


def test_rates(spark):
    rows = [("a", at(0), 10.0), ("a", at(5), 20.0), ("a", at(10), 4.0), ("a", at(41), 9.0), ("b", at(3), 7.0)]
    df = spark.createDataFrame(rows, "name string, ts timestamp_ntz, value double")
    for width in ("1 second", "1 hour"):
        rates = metrics.instant_rate(df, ["name"], time_slices=width)
        got = {(r.name, r.ts): r.rate for r in rates.collect()}
        # growth, reset (the new reading counts), too far apart, first sample
        assert got == {("a", at(0)): None, ("a", at(5)): 2.0, ("a", at(10)): 0.8, ("a", at(41)): None, ("b", at(3)): None}


def test_wider_rate_window(spark):
    df = spark.createDataFrame([("a", at(0), 0.0), ("a", at(50), 100.0)], "name string, ts timestamp_ntz, value double")
    assert metrics.instant_rate(df, ["name"], window="1 minute").where("rate = 2").count() == 1


def test_series_names(spark):
    labels = ['{name="test_taskmanager.2.abc123"}', '{name="test_storage-1.1.x.y"}', '{name="test_plain"}', "other"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, label string")
    got = [r.series for r in metrics.rename_series(df, "cpu").orderBy("i").collect()]
    assert got == ["cpu_taskmanager.2", "cpu_storage-1.1", labels[2], "other"]


def test_totals_and_side_by_side(spark, collected):
    df = spark.createDataFrame(
        [("x", at(0), 1.0), ("x", at(0), 2.0), ("y", at(0), 5.0), ("y", at(5), 6.0)],
        "series string, ts timestamp_ntz, value double")
    assert collected(metrics.totals(df)) == [(at(0), 8.0), (at(5), 6.0)]
    sums = metrics.totals(df, ["series"]).withColumnRenamed("total", "value")
    assert collected(metrics.side_by_side(sums, ["x", "y"])) == [(at(0), 3.0, 5.0), (at(5), None, 6.0)]


def test_warm_up(spark):
    rows = [sample(s=5 * i, replica=r) for i in range(30) for r in (1, 2)] + [sample(run=2, s=5 * i) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = metrics.after_warm_up(df)
    # 30 s is samples 0..6; then ten instants go: 7..16
    assert sorted({r.ts for r in kept.collect()}) == [at(5 * i) for i in range(17, 30)]
    assert kept.count() == 26
    assert kept.where("run_id = 2").count() == 0
    assert metrics.after_warm_up(df, samples_cut=0).where("run_id = 2").count() == 3
    elapsed = metrics.with_elapsed(df).where("run_id = 2").agg(F.max("elapsed")).first()[0]
    assert elapsed == 45.0


@pytest.mark.parametrize("query, share", [(1, 0.92), (3, 0.08), (8, 0.08), (11, 0.92)])
def test_expected_throughput(spark, query, share):
    df = spark.createDataFrame([(query, 50000, 4)], "q int, t int, p int")
    got = df.select(metrics.expected_throughput("q", "t", "p"), metrics.expected_throughput("q", "t", "p", 0.95)).first()
    assert got[0] == pytest.approx(50000 * 4 * share) and got[1] == pytest.approx(50000 * 4 * share * 0.95)


def test_floor_cuts_whole_instants(spark, collected):
    rows = [sample(metric="tput", service="source", s=0, value=4000.0), sample(metric="tput", service="source", replica=2, s=0, value=800.0),
            sample(s=0), sample(metric="tput", service="source", s=5, value=4370.0), sample(s=5),
            sample(query=2, run=2, s=5)]
    kept = metrics.above_floor(spark.createDataFrame(rows, SCHEMA))
    assert collected(kept.select("run_id", "ts").distinct()) == [(1, at(0)), (2, at(5))]
    assert kept.count() == 4


def test_role_usage_sums_means_of_replicas(spark):
    rows = [sample(replica=1, s=0, value=1.0), sample(replica=1, s=5, value=3.0), sample(replica=2, s=0, value=10.0),
            sample(service="storage", value=4.0), sample(metric="network_rate", value=9.0),
            sample(metric="tput", service="source", value=99.0)]
    got = {r.role: r.usage for r in metrics.role_usage(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"processing": 12.0, "storage": 4.0, "network": 9.0}


def test_runs_and_variants(spark, collected):
    rows = [sample(run=1, value=2.0), sample(run=1, variant="pushed", value=1.0), sample(run=2, value=5.0),
            sample(run=3, value=7.0), sample(run=3, variant="pushed", value=7.0),
            sample(run=4, value=4.0), sample(run=4, variant="pushed", value=2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = spark.createDataFrame(
        [(1, "executed"), (2, "executed"), (3, "failed"), (4, "executed")], "run_id int, state string")
    kept = metrics.executed_runs(df, runs)
    assert {r.run_id for r in kept.collect()} == {1, 4}
    compared = metrics.compare_variants(metrics.role_usage(kept))
    assert collected(compared) == [(1, 1, 5000, "processing", 3.0, 1.5, 0.5)]


def test_job_role_means(spark, collected):
    rows = [sample(service="task1", s=0, value=1.0), sample(service="task2", s=0, value=2.0),
            sample(service="task1", s=5, value=5.0), sample(service="proxy", s=0, value=8.0)]
    got = metrics.job_role_means(spark.createDataFrame(rows, SCHEMA), {"task": "^task", "proxy": "prox"})
    assert collected(got) == [("plain", "proxy", 8.0), ("plain", "task", 4.0)]
