import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.scan import (
    Selection, TopicCriteria, observed_scan, require_columns, scan_records, scan_stats, scan_topic, scan_topics,
)
from sluice.sources.topics import RECORD_SCHEMA

SCHEMA = (
    T.StructType().add("a", T.LongType()).add("s", T.StringType()).add("b", T.BooleanType()).add("d", T.StringType())
)

BODIES = [
    '{"a":1007,"s":"x","b":true}',          # 0 match
    '{"a":11007,"s":"y","b":false}',        # 1 contains the pattern 1007
    '{"s":"z"}',                            # 2 without a
    '{"a":null,"s":"n"}',                   # 3 JSON null
    '{"a":{"z":1007},"s":"o"}',             # 4 nested
    None,                                   # 5 tombstone
    '{"a":1020,"s":"1007","d":"[1007]"}',   # 6
    '{"a":5,"s":"last"}',                   # 7 last of the partition, no match
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [("t", 0, i, f"k{i}", body) for i, body in enumerate(BODIES)]
    rows += [("t", 1, 0, "m", '{"a":1007}')]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def offsets(df, partition=0):
    return sorted(r.offset for r in df.where(f"partition = {partition}").collect())


def body(df, offset):
    return df.where(f"partition = 0 and offset = {offset}").first().value


def test_pattern_is_unanchored_and_missing_passes(records):
    kept = scan_records(records, TopicCriteria(selections=(Selection("a", pattern="1007"),)))
    assert offsets(kept) == [0, 1, 2]


def test_exact_selection_needs_the_attribute(records):
    kept = scan_records(records, TopicCriteria(selections=(Selection("a", (1007, 1020)),)))
    assert offsets(kept) == [0, 6]


@pytest.mark.parametrize("attribute, pattern, kept", [
    ("a", "^null$", [2, 3]),            # JSON null reads as null
    ("a", "^$", [2, 4]),                # nested values read as empty
    ("b", "^true$", [0, 2, 3, 4, 6, 7]),
    ("s", "^1007$", [6]),
    ("d", r"^\[1007\]$", [0, 1, 2, 3, 4, 6, 7]),
])
def test_attribute_text(records, attribute, pattern, kept):
    assert offsets(scan_records(records, TopicCriteria(selections=(Selection(attribute, pattern=pattern),)))) == kept


def test_selections_are_anded(records):
    both = TopicCriteria(selections=(Selection("a", pattern="10"), Selection("s", pattern="^[xz]$")))
    assert offsets(scan_records(records, both)) == [0, 2]


def test_projection_keeps_order_absence_and_null(records):
    kept = scan_records(records, TopicCriteria(projections=("s", "a")))
    assert body(kept, 0) == '{"s":"x","a":1007}'
    assert body(kept, 2) == '{"s":"z"}'
    assert body(kept, 3) == '{"s":"n","a":null}'
    assert body(kept, 4) == '{"s":"o","a":{"z":1007}}'
    assert kept.where("key = 'k0'").count() == 1


def test_selection_attribute_need_not_be_projected(records):
    kept = scan_records(records, TopicCriteria(selections=(Selection("a", (1007,)),), projections=("s",)))
    assert body(kept, 0) == '{"s":"x"}'


def test_pass_through_is_the_same_frame(records):
    assert scan_records(records) is records


def test_tail_marker_is_empty(records):
    kept = scan_records(records, TopicCriteria(selections=(Selection("a", (1007,)),)), tail_marker=True)
    rows = {(r.partition, r.offset): (r.key, r.value) for r in kept.collect()}
    assert rows == {
        (0, 0): ("k0", BODIES[0]), (0, 7): (None, None), (1, 0): ("m", '{"a":1007}'),
    }


def test_tombstones_go(records):
    assert 5 not in offsets(scan_records(records, TopicCriteria(projections=("a",))))


def test_malformed(spark):
    rows = [("t", 0, 0, "k", '{"a":1'), ("t", 0, 1, "k", '{"a":7}')]
    bad = spark.createDataFrame(rows, RECORD_SCHEMA)
    criteria = TopicCriteria(selections=(Selection("a", pattern="."),))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        scan_records(bad, criteria).collect()
    assert offsets(scan_records(bad, criteria, on_malformed="drop")) == [1]
    typed = TopicCriteria(projections=("a",))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        scan_topic(bad, SCHEMA, typed).collect()
    assert [r.a for r in scan_topic(bad, SCHEMA, typed, on_malformed="drop").collect()] == [7]
    assert sorted([r.a for r in scan_topic(bad, SCHEMA, typed, on_malformed="null").collect()], key=str) == [7, None]
    with pytest.raises(ValueError):
        scan_topic(bad, SCHEMA, typed, on_malformed="shrug")


def test_text_test_lets_escaped_strings_through(spark):
    rows = [("t", 0, 0, None, '{"s":"\\u004fR"}'), ("t", 0, 1, None, '{"s":"OR"}'), ("t", 0, 2, None, '{"s":"CA"}')]
    df = spark.createDataFrame(rows, RECORD_SCHEMA)
    criteria = TopicCriteria(selections=(Selection("s", ("OR",)),))
    assert scan_topic(df, SCHEMA, criteria, on_malformed="drop").count() == 2


def test_only_named_attributes_are_parsed(records):
    plan = scan_topic(records, SCHEMA, TopicCriteria(projections=("a", "s")))._jdf.queryExecution().toString()
    assert "StructField(b,BooleanType" not in plan.split("== Optimized Logical Plan ==")[1]


def test_unknown_attributes_are_refused(records):
    with pytest.raises(ValueError):
        scan_topic(records, SCHEMA, TopicCriteria(projections=("nope",)))
    with pytest.raises(ValueError):
        require_columns(records, "nope")
    with pytest.raises(ValueError):
        Selection("a")
    with pytest.raises(ValueError):
        Selection("a", (1,), "x")


def test_statistics(records):
    criteria = TopicCriteria(selections=(Selection("a", (1007,)),), projections=("a",))
    row = scan_stats(records, criteria).first()
    read = sum(len(f"k{i}") + len(b) for i, b in enumerate(BODIES) if b) + len("m") + len('{"a":1007}')
    sent = len('k0{"a":1007}') + len('m{"a":1007}')
    assert (row.records, row.kept, row.removed) == (8, 2, 6)
    assert (row.bytes_read, row.bytes_sent, row.bytes_saved) == (read, sent, read - sent)
    assert row.bytes_saved > 0


def test_observed_statistics(records):
    observed = observed_scan(records, TopicCriteria(selections=(Selection("a", (1007,)),)))
    assert observed.count() == 2


def test_several_topics(records):
    read = scan_topics(
        {"one": (records, SCHEMA), "two": (records, SCHEMA)}, {"one": TopicCriteria(projections=("s",))},
        on_malformed="null",
    )
    assert read["one"].columns == ["s"]
    assert read["two"].columns == SCHEMA.names


ROWS = st.lists(
    st.fixed_dictionaries(
        {"a": st.integers(0, 12) | st.none(), "s": st.sampled_from(["x", "y", "zz", 'q"\\', "ü"]) | st.none()}
    ), min_size=1, max_size=12,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, wanted=st.sets(st.integers(0, 12), min_size=1, max_size=3), text=st.sampled_from(["x", 'q"\\', "ü"]),
       ascii_only=st.booleans(), strict=st.booleans())
def test_exact_scan_equals_filter_and_select(spark, rows, wanted, text, ascii_only, strict):
    df = spark.createDataFrame(
        [("t", 0, i, None, json.dumps(r, ensure_ascii=ascii_only)) for i, r in enumerate(rows)], RECORD_SCHEMA
    )
    criteria = TopicCriteria(selections=(Selection("a", tuple(wanted)), Selection("s", (text,))), projections=("s",))
    got = scan_topic(df, SCHEMA, criteria, on_malformed="fail" if strict else "drop")
    want = [r["s"] for r in rows if r["a"] in wanted and r["s"] == text]
    assert [r.s for r in got.collect()] == want
    raw = scan_records(df, criteria).select(F.get_json_object("value", "$.s"))
    assert [r[0] for r in raw.collect()] == want
