import pytest
from pyspark.sql import functions as F

from sluice.functions import keygroups as kg
from sluice.operators import layout
from sluice.operators.scan import TopicCriteria


def values(spark, items, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_long_key_groups(spark):
    df = values(spark, [0, 1, 10, 1007, 1020, 2001, -1, 2**40 + 7], "bigint")
    group = kg.key_group(kg.java_hash("v", "long"))
    assert column(df, group) == [94, 86, 67, 55, 45, 114, 94, 23]
    assert column(df, kg.slot(group, 4)) == [2, 2, 2, 1, 1, 3, 2, 0]


def test_string_hashes(spark):
    df = values(spark, ["", "OR", "bid", "person", "auction", "1007"], "string")
    code = kg.java_hash("v", "string")
    assert column(df, code) == [0, 2531, 97533, -991716523, -661856701, 1507430]
    assert column(df, kg.key_group(code)) == [94, 57, 24, 16, 108, 59]


def test_string_hash_counts_code_points(spark):
    df = values(spark, ["é😀"], "string")
    assert column(df, kg.java_hash("v", "string")) == [ord("é") * 31 + ord("😀")]


def test_composite_hash_and_absent_fields(spark):
    df = spark.createDataFrame([(0, "OR", 1007), (1, None, 1007), (2, None, None)], "i int, s string, l bigint")
    code = kg.composite_hash([("s", "string"), ("l", "long")])
    assert column(df, code) == [2572, 1007, 0]
    assert column(df, kg.key_group(code)) == [105, 55, 94]


def test_extreme_hash_codes_stay_in_range(spark):
    df = values(spark, [-2**31, 2**31 - 1, -1, 0, 12345], "int")
    assert all(0 <= g < 7 for g in column(df, kg.key_group("v", 7)))


def murmur(code):
    """The key-group hash with plain integers."""
    word = 0xFFFFFFFF
    turn = lambda x, n: ((x << n) | (x >> (32 - n))) & word
    x = turn((code & word) * 0xCC9E2D51 & word, 15) * 0x1B873593 & word
    x = (turn(x, 13) * 5 + 0xE6546B64) & word ^ 4
    x = (x ^ x >> 16) * 0x85EBCA6B & word
    x = (x ^ x >> 13) * 0xC2B2AE35 & word
    x ^= x >> 16
    return x if x < 2**31 else 0 if x == 2**31 else 2**32 - x


def test_key_group_equals_plain_arithmetic(spark):
    codes = [(i * 2654435761 + 12345) % 2**32 - 2**31 for i in range(500)]
    df = values(spark, codes, "int")
    assert column(df, kg.key_group("v", 32768)) == [murmur(c) % 32768 for c in codes]


@pytest.mark.parametrize("topic, owners", [("bid", [3, 0, 1, 2]), ("person", [3, 0, 1, 2]), ("auction", [1, 2, 3, 0])])
def test_split_owners(spark, topic, owners):
    df = values(spark, [0, 1, 2, 3], "int")
    assert column(df, kg.split_owner(F.lit(topic), "v", 4)) == owners


@pytest.mark.parametrize("sources, partitions, origins", [
    (2, 2, [0, 1, 1, 0]), (3, 2, [0, 1, 0, 1, 0, 1]), (1, 4, [0, 1, 2, 3]), (2, 4, [0, 1, 1, 2, 2, 3, 3, 0]),
])
def test_origin_partitions(spark, sources, partitions, origins):
    mapping = layout.virtual_partitions(spark, "bid", sources, partitions)
    assert [r.origin for r in mapping.orderBy("virtual").collect()] == origins


def test_virtuals_by_origin(spark, collected):
    mapping = layout.virtual_partitions(spark, "bid", 2, 2)
    assert collected(layout.virtuals_by_origin(mapping)) == [("bid", 0, [0, 3]), ("bid", 1, [1, 2])]


def test_offsets_go_there_and_back(spark):
    df = values(spark, [0, 1, 2**60], "bigint")
    moved = kg.virtual_offset("v", F.lit(3), 4)
    assert column(df, moved) == [3, 7, 2**62 + 3]
    assert column(df, kg.real_offset(moved, F.lit(3), 4)) == [0, 1, 2**60]


KEYS = TopicCriteria(partition_keys=(("s", "string"), ("l", "long"), ("n", "int")), num_sources=4, num_partitions=2)


def test_keys_from_json(spark):
    bodies = ['{"s":"OR","l":1007}', '{"s":5,"l":"x","n":null}', '{"l":1007.5}', '{"n":4294967297}', "{}"]
    from sluice.operators.scan import key_fields, with_key_row
    df = with_key_row(values(spark, bodies, "string").withColumnRenamed("v", "value"), KEYS)
    fields = key_fields(KEYS)
    assert column(df, fields[0][0]) == ["OR", "", None, None, None]
    assert column(df, fields[1][0]) == [1007, 0, 0, None, None]
    assert column(df, fields[2][0]) == [None, 0, None, 1, None]
    assert column(df, kg.composite_hash(fields)) == [2572, 0, 0, 1, 0]


def test_deal_out_finds_the_owner(spark):
    criteria = TopicCriteria(partition_keys=(("auction", "long"),), num_sources=2, num_partitions=2)
    records = spark.createDataFrame(
        [("bid", p, o, None, f'{{"auction":{1000 + o}}}') for p in (0, 1) for o in range(20)],
        "topic string, partition int, offset bigint, key string, value string",
    )
    dealt = layout.deal_out(records, "bid", criteria).collect()
    mapping = {r.virtual: r for r in layout.virtual_partitions(spark, "bid", 2, 2).collect()}
    assert len(dealt) == 40
    for row in dealt:
        assert mapping[row.virtual].origin == row.partition
        assert mapping[row.virtual].owner == row.slot
    moved = layout.by_virtual_partition(layout.deal_out(records, "bid", criteria), criteria)
    assert moved.where(F.spark_partition_id() != F.col("virtual")).count() == 0


def test_slot_filter(spark):
    df = values(spark, list(range(100)), "bigint")
    parts = [layout.of_slot(df, [("v", "long")], k, 4).count() for k in range(4)]
    assert sum(parts) == 100 and all(parts)
