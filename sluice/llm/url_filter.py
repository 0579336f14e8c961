"""URL filtering by mined association rules.

Hand-written rules (host and path prefix, the longest wins) judge first. For the rest FP-growth mines combinations of URL
tokens from labelled pages; combinations of any length that imply a block on enough pages, the same number for every
size of the input, and with enough confidence become rules, unless a rule of one token less covers them. A rule is
indexed under its rarest part: a URL meets only the rules of its own tokens and fits one if it has all parts of it.
Only DataFrame functions and Spark's FP-growth are used, whose driver holds the items of the baskets with their counts.

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens and the verdict of no rule;
repeated pages are judged alike; pages without labels, or an empty table, give no mined rules; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ascii_lower, written

#: Verdict, host and path prefix of the hand-written rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

MIN_PAGES = 20  # a rule rests on this many blocked labelled pages at least, however few or many there are
MIN_CONFIDENCE = 0.9
BLOCK = "verdict=block"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for said, domain, prefix in sorted(RULES if rules is None else rules, key=lambda r: len(r[1] + r[2])):
        fits = (F.concat(F.lit("."), host).endswith(f".{domain}")) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """What stands in a URL: host labels and their parts, path segments, query names; numbers are all alike."""
    host, path = host_of(url), ascii_lower(path_of(url))
    labels = F.split(host, r"\.")
    named = lambda kind, part: F.concat(F.lit(kind), part)
    general = lambda part: F.regexp_replace(part, "[0-9]+", "0")
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    parts = F.concat(
        F.transform(labels, lambda x: named("host=", x)),
        F.transform(F.split(host, r"[.\-_]"), lambda x: named("word=", x)),
        F.transform(F.split(path, "/"), lambda x: named("path=", general(x))),
        F.transform(F.split(query, "&"), lambda x: named("query=", F.substring_index(x, "=", 1))))
    return F.array_distinct(F.filter(parts, lambda x: ~x.endswith("=")))


def _token_classes(seen: DataFrame, min_pages: int) -> DataFrame:
    """Tokens of at least ``min_pages`` blocked pages as ``item, members, freq, pages``: tokens that stand on the same
    pages are one class, since no rule can tell them apart; all of a class stand in one URL, so classes are short."""
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(i), "page"), 33)).alias(f"s{i}") for i in range(2)]
    each = seen.select("page", "block", F.explode("have").alias("token")).groupBy("token").agg(
        F.count("*").alias("freq"), F.count_if("block").alias("pages"), *sums).where(F.col("pages") >= min_pages)
    return each.groupBy("freq", "pages", "s0", "s1").agg(
        F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members")).drop("s0", "s1")


def mined_rules(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``labelled`` has ``url`` and ``block`` (boolean). Gives ``rule, parts, rarest, confidence, pages``: a URL fits if it
    has a token of each part; ``rarest`` is the part that the fewest pages have.

    Tokens that block by themselves are rules and leave the baskets, as all that holds one of them is covered. What is
    left of tokens, a class of equal pages as one item, is mined by FP-growth, so that a long URL that many pages share
    is one item and not as many sets as its tokens have.
    """
    spark = labelled.sparkSession
    seen = written(
        labelled.where(F.col("block").isNotNull()).select("block", tokens_of(F.col("url")).alias("have"))
        .withColumn("page", F.monotonically_increasing_id()), "url-labelled")
    confidence = F.col("pages") / F.col("freq")
    classes = written(_token_classes(seen, min_pages).withColumn("confidence", confidence), "url-classes")
    alone = classes.where(F.col("confidence") >= min_confidence).select(F.explode("members").alias("rule"), "confidence", "pages").select(
        "rule", F.array(F.array("rule")).alias("parts"), F.array("rule").alias("rarest"), "confidence", "pages")
    rest = classes.where(F.col("confidence") < min_confidence)
    items = seen.select("page", "block", F.explode("have").alias("item")).join(rest.select("item"), "item").groupBy("page", "block").agg(
        F.collect_list("item").alias("items"))
    baskets = written(items.select(
        F.when(F.col("block"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items")), "url-baskets")
    # Half a page less, since the product of share and pages is rounded up.
    support = min(1.0, (min_pages - 0.5) / max(1, baskets.count()))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence, numPartitions=partitions).fit(baskets)
    said = F.array_contains("items", BLOCK)
    sets = written(model.freqItemsets.where(F.col("freq") >= min_pages).select(
        F.array_sort(F.array_remove("items", BLOCK)).alias("tokens"), said.alias("said"), "freq"), "url-itemsets")
    blocked = sets.where("said AND size(tokens) > 1").select("tokens", F.col("freq").alias("pages"))
    accepted = written(
        blocked.join(sets.where("NOT said"), "tokens").withColumn("confidence", confidence)
        .where(F.col("confidence") >= min_confidence).select("tokens", "confidence", "pages"), "url-accepted")
    # A rule that is one token longer than another fits no page that the other does not.
    shorter = F.transform("tokens", lambda x: F.array_remove("tokens", x))
    covered = accepted.select("tokens", F.explode(shorter).alias("less")).join(
        accepted.select(F.col("tokens").alias("less")), "less").select("tokens").distinct()
    rules = accepted.join(covered, "tokens", "left_anti")
    each = rules.select("tokens", "confidence", "pages", F.explode("tokens").alias("item")).join(
        rest.select("item", "members", "freq"), "item")
    joint = each.groupBy("tokens").agg(
        F.sort_array(F.collect_list("members")).alias("parts"), F.min_by("members", F.struct("freq", "item")).alias("rarest"),
        F.max("confidence").alias("confidence"), F.max("pages").alias("pages"))
    return written(alone.unionByName(joint.select(F.array_join("tokens", " ").alias("rule"), "parts", "rarest", "confidence", "pages")),
                   "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` that fit a mined rule, with the strongest ``mined_rule``."""
    seen = urls.select("url").distinct().withColumn("have", tokens_of(F.col("url")))
    met = seen.select("url", "have", F.explode("have").alias("token")).join(
        rules.select(F.explode("rarest").alias("token"), "rule", "parts", "confidence"), "token")
    return met.where(F.forall("parts", lambda part: F.arrays_overlap(part, "have"))).groupBy("url").agg(
        F.max_by("rule", F.struct("confidence", "rule")).alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame, rules=None, **limits) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, mined_rule``.

    ``labels`` has ``page_id`` and ``block``. Pages that a hand-written rule judges are not mined: they need no other rule,
    and what the rules say is not what the labels say.
    """
    url = F.col("url")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)}).withColumns(
        {"rule": name, "said": verdict})
    own = labels.groupBy("page_id").agg(F.max(F.col("block").cast("int")).alias("own"))
    labelled = judged.where("said IS NULL").join(own, "page_id").select("url", (F.col("own") == 1).alias("block"))
    unjudged = judged.where("said IS NULL AND url IS NOT NULL")
    found = matched(unjudged, mined_rules(labelled, **limits))
    return judged.join(found, "url", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("said").isNull(), F.col("mined_rule")).alias("mined_rule"))
