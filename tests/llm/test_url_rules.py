"""Mined URL rules: the same number of pages at every size, antecedents of any length, none that a shorter one covers."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from sluice.llm.url_filter import judge, matched, mined_rules


def test_twenty_pages_are_enough_in_a_large_table(spark):
    rows = spark.range(20_020).select(
        F.when(F.col("id") < 20, F.concat(F.lit("http://bad.test/"), "id")).when(
            F.col("id") < 39, F.concat(F.lit("http://few.test/"), "id")).otherwise(
            F.concat(F.lit("http://good.test/"), "id")).alias("url"), (F.col("id") < 39).alias("block"))
    rules = mined_rules(rows)
    assert sorted(r.rule for r in rules.collect()) == ["host=bad", "word=bad"]
    asked = spark.createDataFrame([("http://bad.test/new",), ("http://few.test/new",), ("http://good.test/new",)], "url string")
    assert {r.url for r in matched(asked, rules).collect()} == {"http://bad.test/new"}


def test_rules_of_four_tokens(spark):
    parts = ["a", "b", "c", "d"]
    urls = [("http://x/" + "/".join(parts), True)] * 30
    for gone in parts:  # any three of the four are as often allowed as blocked
        urls += [("http://x/" + "/".join(p for p in parts if p != gone), False)] * 30
    rules = mined_rules(spark.createDataFrame(urls, "url string, block boolean"))
    assert [(r.rule, r.confidence, r.pages) for r in rules.collect()] == [("path=a path=b path=c path=d", 1.0, 30)]


def test_fewer_pages_than_the_least_give_no_rule(spark):
    assert mined_rules(spark.createDataFrame([("http://x/", True)] * 19, "url string, block boolean")).count() == 0


def test_long_urls_that_many_pages_share(spark):
    long = "http://h.test/" + "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)) + "?" + "&".join(f"q{chr(97 + i)}=1" for i in range(20))
    urls = [(long, i < 14) for i in range(25)] * 2 + [(f"http://h.test/other/{i}", False) for i in range(50)]
    df = spark.createDataFrame(urls, "url string, block boolean")
    assert mined_rules(df, min_confidence=0.9).count() == 0
    assert mined_rules(df, min_confidence=0.5).count() >= 60  # each of its tokens is a rule


def tokens(url):
    """Tokens of the plain URLs below."""
    host, _, path = url.removeprefix("http://").partition("/")
    return {f"host={x}" for x in host.split(".")} | {f"word={x}" for x in re.split(r"[.-]", host)} | {
        f"path={x}" for x in path.split("/") if x}


def test_planted_signal_is_found_and_holds_on_other_pages(spark):
    """Verdicts equal those of all token sets in plain Python; of the pages held out, what is blocked is bad."""
    draw = random.Random(9)
    rows = []
    for i in range(1200):
        url = f"http://{draw.choice(['www', 'm', 'cdn'])}.{draw.choice(['ads-x', 'news', 'shop', 'blog'])}.test/" + "/".join(
            draw.sample(["cheap", "pills", "story", "item", "win"], draw.randint(1, 3)))
        have = tokens(url)
        bad = "word=ads" in have or {"path=cheap", "path=pills"} <= have or {"host=shop", "path=win"} <= have
        rows.append((i, url, bad if draw.random() > 0.02 else not bad))
    learnt, asked = [r for r in rows if r[0] % 4], [r for r in rows if not r[0] % 4]
    counts, blocked = {}, {}
    for _, url, block in learnt:
        for size in range(1, 5):
            for chosen in combinations(sorted(tokens(url)), size):
                counts[chosen] = counts.get(chosen, 0) + 1
                blocked[chosen] = blocked.get(chosen, 0) + block
    rules = [set(c) for c, n in blocked.items() if n >= 20 and n / counts[c] >= 0.9]
    want = {url for _, url, _ in asked if any(r <= tokens(url) for r in rules)}
    pages = spark.createDataFrame([(i, url) for i, url, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, block) for i, _, block in learnt], "page_id long, block boolean")
    got = {r.page_id: r for r in judge(pages, labels).collect()}
    assert {r[1] for r in asked if got[r[0]].verdict == "block"} == want
    hits = [bad for i, _, bad in asked if got[i].verdict == "block"]
    assert len(hits) > 50 and sum(hits) / len(hits) >= 0.9


def test_pages_of_hand_written_rules_are_not_mined(spark):
    pages = [(i, f"http://a.net/de/{i}/ref") for i in range(60)] + [(100 + i, f"http://b.test/de/{i}/ref") for i in range(10)]
    labels = [(i, True) for i in range(60)] + [(100 + i, False) for i in range(10)]
    found = judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, block boolean"))
    assert {r.verdict for r in found.where("page_id >= 100").collect()} == {"allow"}
