import random
import re
from time import perf_counter

import pytest
from pyspark.sql import functions as F


from sluice.functions.patterns import any_of, required_literals
from sluice.operators import routing
from sluice.operators.routing import Rule, clusters, route, route_by_key_text

RULES = [Rule("tomato-cluster", key="tomato"), Rule("caution-cluster", key="potato", value="caution"),
         Rule("value-cluster", value="^only")]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(0, "1234tomato", "v"), (1, "potato", "caution"), (2, "potato", "fine"), (3, "x", "only this"),
            (4, None, "only null key"), (5, "x", None)]
    return spark.createDataFrame(rows, "i int, key string, value string")


def test_first_rule_wins(records):
    got = [r.c for r in records.orderBy("i").select(route("key", "value", RULES, "default").alias("c")).collect()]
    assert got == ["tomato-cluster", "caution-cluster", "default", "value-cluster", "value-cluster", "default"]


def test_by_key_text(records):
    rules = [Rule("a", key="tom"), Rule("b", key="o")]
    got = [r.c for r in records.orderBy("i").select(route_by_key_text("key", rules, "d").alias("c")).collect()]
    assert got == ["a", "b", "b", "d", "d", "d"]
    with pytest.raises(ValueError):
        route_by_key_text("key", RULES, "d")


def test_key_text_is_not_a_pattern(records):
    got = records.select(route_by_key_text("key", [Rule("a", key="t.m")], "d").alias("c")).distinct().collect()
    assert [r.c for r in got] == ["d"]


def test_no_rules(records):
    assert records.select(route("key", "value", [], "d").alias("c")).distinct().count() == 1


def test_clusters(spark):
    got = [r.cluster for r in clusters(spark, RULES, "core", "edge").collect()]
    assert got == ["caution-cluster", "core", "edge", "tomato-cluster", "value-cluster"]


def test_required_literals():
    assert required_literals("^Customer#0+1.*") == ("Customer#0",)
    assert required_literals("1007|1020") == ("1007", "1020")
    assert required_literals(r"a\.bc?d+e") == ("a.b",)
    assert required_literals("x(ab|cd)yz{2}(q)?") == ("x",) or required_literals("x(ab|cd)yz{2}(q)?") == ("y",)
    for unclear in ("", "a|", "(?i)abc", "[abc]", "a*", r"\Qa.b\E", "a)", "[a[b]]", "(abc"):
        assert required_literals(unclear) is None, unclear


def test_literals_are_never_missed():
    """Random patterns over a small alphabet: whatever Python matches has one of the literals."""
    draw = random.Random(4)
    parts = ["a", "b", "ab", "ba.", "[ab]", "(a|b)", "a*", "b+", "c?", "(?:ab)+", "^", "|", "a{2}", r"\w", r"\.", "(bc)?"]
    tried = 0
    for _ in range(3000):
        pattern = "".join(draw.choice(parts) for _ in range(draw.randint(1, 6)))
        literals = required_literals(pattern)
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        for _ in range(10):
            text = "".join(draw.choice("abc.x") for _ in range(draw.randint(0, 8)))
            if literals and compiled.search(text):
                tried += 1
                assert any(x in text for x in literals), (pattern, text)
    assert tried > 1000


def test_any_of():
    words = ["ab", "abc", "b.d", "b", "x|y"]
    compiled = re.compile(f"(?=({any_of(words)}))")
    assert [m[1] for m in compiled.finditer("zabcb.dx|y")] == ["abc", "b", "b.d", "x|y"]


def test_many_rules_as_one_after_another(spark, monkeypatch):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcd.") for _ in range(draw.randint(1, 4)))
    pattern = lambda: draw.choice([None, word(), f"^{word()}", f"{word()}|{word()}", "[ab]+c", f"{word()}.*{word()}"])
    rules = [Rule(f"c{i}", key=pattern(), value=pattern()) for i in range(120)]
    rules = [r for r in rules if r.key or r.value]
    texts = [Rule(f"c{i}", key=word()) for i in range(100)] + [Rule("dot", key="")]
    df = spark.createDataFrame([(i, word() + word(), word() * 2) for i in range(400)] + [(1000, None, None)], "i int, key string, value string")
    got = {}
    for start in (1, 10_000):
        monkeypatch.setattr(routing, "INDEXED_FROM", start)
        rows = df.select("i", route("key", "value", rules, "d").alias("a"), route_by_key_text("key", texts, "d").alias("b")).collect()
        got[start] = sorted(tuple(r) for r in rows)
    assert got[1] == got[10_000] and len({r[1] for r in got[1]}) > 10


def test_a_thousand_rules_cost_little_more_than_a_hundred(spark):
    records = spark.range(20_000).select(F.concat(F.lit("key-"), F.col("id") % 977).alias("key"), F.lit("v").alias("value"))

    def seconds(count):
        rules = [Rule(f"c{i}", key=f"^key-{i}$") for i in range(count)]
        df = records.select(route("key", "value", rules, "d").alias("c"))
        assert df.where("c = 'c7'").count() == 21
        start = perf_counter()
        df.groupBy("c").count().collect()
        return perf_counter() - start

    seconds(100)
    assert seconds(1000) < 5 * seconds(100) + 2
