"""Line dedup over levelled sorted runs of line hashes.

A run holds the keys of some batches of documents: 128 bits of hash and the number of documents with the line. Runs are
bucketed and sorted by hash, so that joins and merges with them shuffle nothing of theirs. A new batch first leaves out
(merge anti-join) the keys that the runs already know to be frequent, then becomes a run of level 0. ``fanout`` runs of
one level are merged into one of the next. Documents are read once for their hashes and once to be rewritten.

Defined results: a null or empty text is one empty line; every row counts as a document of its own, repeated rows and
null ids too; empty lines have no key and stay; a text without lines left is empty. Other columns pass through.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import BLANKS, ascii_lower, let, row_key, written
from sluice.session import shared_folder

KEY = ["h1", "h2"]
BATCHES = 4


def line_keys(text: Column) -> Column:
    """For each line the hashes of its key; null for an empty key."""
    def key(line: Column) -> Column:
        return let(ascii_lower(F.btrim(line, F.lit(BLANKS))), lambda k: F.when(
            k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), key)


class LineRuns:
    """The levels of runs; ``min_docs`` documents make a line frequent."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option(
            "path", shared_folder(self.spark, "line-run")).saveAsTable(name)
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        """One run out of several: a merge join of sorted buckets, which shuffles nothing."""
        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return left.join(right.withColumnRenamed("docs", "more"), KEY, "full_outer").select(*KEY, docs.alias("docs"))
        return reduce(both, [self.spark.table(run) for run in runs])

    def _unknown(self, counts: DataFrame) -> DataFrame:
        """What the runs do not know to be frequent yet."""
        for run in (run for level in self.levels for run in level):
            frequent = self.spark.table(run).where(F.col("docs") >= self.min_docs).select(*KEY)
            counts = counts.join(frequent, KEY, "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """Takes the counts ``h1, h2, docs`` of a batch, distinct by key."""
        self.levels[0].append(self._write(self._unknown(counts)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(full)))
            for run in full:
                self.spark.sql(f"DROP TABLE {run}")
            level += 1

    def frequent(self) -> DataFrame:
        runs = [run for level in self.levels for run in level]
        return self._merged(runs).where(F.col("docs") >= self.min_docs).select(*KEY)


def dedup(docs: DataFrame, min_docs: int = 10, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``docs`` with frequent lines taken out of ``text``, and ``n_lines``, ``n_dropped``."""
    spark = docs.sparkSession
    keyed = written(docs.select(*row_key(*_identity(docs, text)), line_keys(F.col(text)).alias("keys")), "line-keys")
    batch = F.pmod(F.col("k1"), F.lit(batches))
    counts = written(
        keyed.select(batch.alias("batch"), F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        .groupBy("batch", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).agg(F.count("*").alias("docs")),
        "line-counts")
    runs = LineRuns(spark, min_docs)
    for number in range(batches):
        runs.add(counts.where(F.col("batch") == number).select(*KEY, "docs"))
    frequent = written(runs.frequent(), "frequent-lines")

    # Only the places of frequent lines travel; a text is moved once, beside the places of its own lines.
    hits = (
        keyed.dropDuplicates(["k1", "k2"]).select("k1", "k2", F.posexplode("keys").alias("at", "key"))
        .select("k1", "k2", "at", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"))
        .join(frequent, KEY, "left_semi").groupBy("k1", "k2").agg(F.collect_list("at").alias("_places")))
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places"))
    shorter = let(lines, lambda parts: F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    k1, k2 = row_key(*_identity(docs, text))
    return (
        docs.withColumns({"_k1": k1, "_k2": k2})
        .join(hits.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left")
        .withColumns({
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size("_places"), F.lit(0)).cast("long"),
            text: F.when(F.col("_places").isNull(), whole).otherwise(shorter)})
        .drop("_k1", "_k2", "_places"))


def _identity(docs: DataFrame, text: str) -> list[str]:
    return [c for c in ("doc_id", text) if c in docs.columns]
