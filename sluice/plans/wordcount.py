"""Word counts over text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import words
from ..operators.timeline import SPAN_SLICES, running_sum


def word_rows(lines: DataFrame, text: str = "text", *, rebalance: int | None = None) -> DataFrame:
    """One row per word. ``rebalance`` deals the lines out evenly first: for a few long files on many cores."""
    lines = lines.select(text)
    if rebalance:
        lines = lines.repartition(rebalance)
    return lines.select(F.explode(words(text)).alias("word"))


def wordcount(lines: DataFrame, text: str = "text", *, rebalance: int | None = None) -> DataFrame:
    """Words and how often they occur; counted before they are shuffled."""
    return word_rows(lines, text, rebalance=rebalance).groupBy("word").agg(F.count(F.lit(1)).alias("num"))


def wordcount_two_inputs(one: DataFrame, two: DataFrame, text: str = "text") -> DataFrame:
    """Words of two inputs, counted together."""
    return wordcount(one.select(text).unionByName(two.select(text)), text)


def wordcount_running(lines: DataFrame, position: str, text: str = "text", *, lines_per_slice: int = 1_000,
                      slices_per_span: int = SPAN_SLICES) -> DataFrame:
    """Every word occurrence with its count so far, lines in order of the (integer, unique) position column."""
    occurrences = lines.select(position, F.posexplode(words(text)).alias("place", "word"))
    slices = F.call_function("div", F.col(position), F.lit(lines_per_slice))
    spans = F.call_function("div", F.col("_slice"), F.lit(slices_per_span))
    counted = running_sum(
        occurrences, ["word"], [position, "place"], slices, F.lit(1).cast("bigint"), "num", span_by=spans)
    return counted.select(position, "place", "word", "num")
