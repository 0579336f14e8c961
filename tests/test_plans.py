"""The shape of physical plans: what is pushed down, what is shuffled, and what must not occur."""

import re

import pytest
from pyspark.sql import functions as F

from sluice.plans import auctions
from sluice.plans.catalog import CATALOG
from sluice.plans.pushdown import over_topics
from sluice.sources import mapped, topics


@pytest.fixture(scope="module", autouse=True)
def static_plans(spark):
    """Without AQE the whole plan is fixed before it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(CATALOG))
def test_no_pairs_and_no_python(spark, small, name):
    plan = plan_of(CATALOG[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert not re.search(r"EvalPython|InPandas|InArrow", plan)
    assert "SinglePartition" not in plan


@pytest.fixture(scope="module")
def stored_bids(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    mapped.bid(spark, small).write.parquet(f"{path}/bid")
    mapped.bid(spark, small).write.json(f"{path}/bid_json")
    mapped.bid_records(spark, small).write.parquet(f"{path}/records")
    return path


def test_selection_and_projection_reach_the_files(spark, stored_bids):
    plan = plan_of(auctions.q2(spark.read.parquet(f"{stored_bids}/bid")))
    assert "In(auction, [1007,1020,2001,2019,2087])" in plan
    assert "ReadSchema: struct<auction:bigint,price:bigint>" in plan
    schema = spark.read.parquet(f"{stored_bids}/bid").schema
    plan = plan_of(auctions.q2(spark.read.schema(schema).json(f"{stored_bids}/bid_json")))
    assert "PushedFilters: [In(auction" in plan
    assert "ReadSchema: struct<auction:bigint,price:bigint>" in plan


def test_record_scans_parse_once(spark, stored_bids):
    records = topics.file_records(spark, f"{stored_bids}/records", file_format="parquet")
    for mode in ("fail", "drop"):
        plan = plan_of(over_topics("q2", {"bid": records}, on_malformed=mode))
        assert plan.count("from_json(") == 1
        assert "bidder" not in plan and "ReadSchema: struct<value:string>" in plan


@pytest.mark.parametrize(("name", "topics_read"), [("deal_out", 1), ("pushdown_savings", 3), ("scan_savings", 1)])
def test_a_topic_is_parsed_once(spark, small, name, topics_read):
    assert plan_of(CATALOG[name](spark, small)).count("from_json(") == topics_read


def test_hot_items_read_their_bids_once(spark, small):
    assert "ReusedExchange" in plan_of(CATALOG["q5"](spark, small))


@pytest.mark.parametrize("name", ["q5", "q5_counts", "q11", "q11_composite", "wordcount_all", "scan_savings"])
def test_rows_are_combined_before_the_first_shuffle(spark, small, name):
    plan = plan_of(CATALOG[name](spark, small)).splitlines()
    lowest = max(i for i, line in enumerate(plan) if re.search(r"Exchange hash", line) and "Reused" not in line)
    assert "HashAggregate" in plan[lowest + 1] and "partial_" in plan[lowest + 1]


@pytest.mark.parametrize("name", [n for n in CATALOG if n.startswith(("scan_json", "scan_proj", "keygroup", "route_r", "q0", "q1_"))])
def test_row_local_queries_do_not_shuffle(spark, small, name):
    assert "Exchange" not in plan_of(CATALOG[name](spark, small))


def test_dealing_out_broadcasts_the_mapping(spark, small):
    plan = plan_of(CATALOG["deal_out"](spark, small))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_warm_up_ranking_is_limited_on_the_map_side(spark, small):
    plan = plan_of(CATALOG["warm_up_cut"](spark, small))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_slot_is_read_from_its_own_files(spark, folder):
    from sluice.operators import layout

    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), "id")
    layout.write_by_slot(rows, [("k", "long")], f"{folder}/t", 4, files_per_slot=3)
    read = layout.read_slots(spark, f"{folder}/t", rows.schema, 1)
    want = layout.of_slot(rows, [("k", "long")], 1, 4)
    assert read.count() == want.count() > 0
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "(slot" in plan
    files = spark.read.parquet(f"{folder}/t").where("slot = 1").select(F.input_file_name()).distinct().collect()
    assert files and all("slot=1" in f[0] for f in files)


def test_pattern_scans_look_for_plain_text_before_they_parse(spark, small):
    for name, text in (("q2_pattern", "Contains("), ("prefix_filter", "Contains(")):
        plan = CATALOG[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert text in plan, name
