"""Routing records to clusters by ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import any_of, required_literals

# From so many rules on a record is held only against those that an index by their plain texts names.
INDEXED_FROM = 32


@dataclass(frozen=True)
class Rule:
    """Patterns may occur anywhere in the text; a missing pattern matches every record."""

    cluster: str
    key: str | None = None
    value: str | None = None


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _first_match(tests: list[tuple[Column, str]], default: str) -> Column:
    chain = None
    for test, cluster in tests:
        chain = F.when(test, F.lit(cluster)) if chain is None else chain.when(test, F.lit(cluster))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def route(key, value, rules: Sequence[Rule], default: str) -> Column:
    """Cluster of the first rule whose key and value patterns both match; else the default."""
    key, value = F.coalesce(_col(key), F.lit("")), F.coalesce(_col(value), F.lit(""))
    if len(rules) >= INDEXED_FROM:
        named = [(rule, rule.key and required_literals(rule.key), rule.value and required_literals(rule.value)) for rule in rules]
        return _indexed(key, value, named, default, F.rlike)
    tests = []
    for rule in rules:
        test = F.lit(True)
        if rule.key is not None:
            test = test & key.rlike(rule.key)
        if rule.value is not None:
            test = test & value.rlike(rule.value)
        tests.append((test, rule.cluster))
    return _first_match(tests, default)


def route_by_key_text(key, rules: Sequence[Rule], default: str) -> Column:
    """Cluster of the first rule whose key text is contained in the key; else the default."""
    missing = [rule for rule in rules if rule.key is None]
    if missing:
        raise ValueError("rules matched by key text need a key")
    key = F.coalesce(_col(key), F.lit(""))
    if len(rules) >= INDEXED_FROM:
        named = [(rule, (rule.key,) if rule.key else None, None) for rule in rules]
        return _indexed(key, F.lit(""), named, default, lambda text, part: text.contains(part))
    return _first_match([(key.contains(rule.key), rule.cluster) for rule in rules], default)


def _found(text: Column, literals: dict[str, list[int]]) -> Column:
    """Numbers of the rules whose literals occur in the text."""
    if not literals:
        return F.array().cast("array<int>")
    # At every place of the text the longest literal that begins there; those that it begins with occur there too.
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({any_of(literals)}))"), F.lit(1)))
    begins = {whole: sorted({n for size in range(1, len(whole) + 1) for n in literals.get(whole[:size], ())}) for whole in literals}
    keys = F.array(*[F.lit(k) for k in begins])
    numbers = F.array(*[F.array(*[F.lit(n) for n in ns]) for ns in begins.values()])
    return F.flatten(F.transform(hits, lambda hit: F.get(numbers, F.array_position(keys, hit).cast("int") - 1)))


def _indexed(key: Column, value: Column, named: list, default: str, matches) -> Column:
    """The first matching rule of those that have one of their literals in the record, or none to look for."""
    by_key, by_value, always = {}, {}, []
    for number, (_, of_key, of_value) in enumerate(named):
        index, literals = max(((by_key, of_key), (by_value, of_value)), key=lambda x: min(map(len, x[1])) if x[1] else 0)
        for literal in literals or ():
            index.setdefault(literal, []).append(number)
        if not literals:
            always.append(number)
    everything = F.array(*[F.lit(n) for n in always]) if always else F.array().cast("array<int>")
    candidates = F.array_sort(F.array_distinct(F.concat(_found(key, by_key), _found(value, by_value), everything)))
    # A rule without a pattern has the empty one, which every text matches.
    keys, values, clusters_ = (
        F.array(*[F.lit(x) for x in column]) for column in
        ([r.key or "" for r, _, _ in named], [r.value or "" for r, _, _ in named], [r.cluster for r, _, _ in named]))
    fits = F.filter(candidates, lambda n: matches(key, F.get(keys, n)) & matches(value, F.get(values, n)))
    return F.coalesce(F.get(clusters_, F.get(fits, F.lit(0))), F.lit(default))


def clusters(spark: SparkSession, rules: Sequence[Rule], default: str, local: str) -> DataFrame:
    """Every cluster that the rules can name, each once, in order."""
    names = [(name,) for name in (default, local, *(rule.cluster for rule in rules))]
    return spark.createDataFrame(names, "cluster string").distinct().orderBy("cluster")
