"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: a shard is a bounded number of words of whole documents, and holds for each term the
ascending places where it stands, counted over the shard (a gap, as wide as a phrase reaches, separates documents and
counts like words, so that a shard holds a bounded number of empty texts too). Postings are stored for the terms
of the test set, which is broadcast in blocks of about ``TERMS`` words of phrases. A phrase is looked up in every shard from the
rarest of its terms, by its number of postings in the whole index, to the commonest: each list is shifted by the term's
place in the phrase and intersected with what is left. A search yields numbers of phrases; the items that have them are
joined in Spark, so a phrase that all items share is not sent anywhere with all its items. With ``slop`` above zero a term may stand that many words off its
place (proximity); zero asks for the exact phrase.

Defined results: null and empty texts have no words and no hits; items without words match nothing; items that share a
text or an id each count by their id, and one with a null id marks words but is not counted; repeated documents are searched each for itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ALNUM_WORDS, row_key, texts, written

WINDOW = 10
SHARD_WORDS = 500_000
TERMS = 500_000  # words of phrases that are broadcast at once, each phrase with all its words


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_WORDS).split()


def phrases(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``phrase`` (a number), ``terms`` and ``item`` for the runs of ``window`` words, or shorter whole items."""
    def cut(batches):
        for batch in batches:
            rows = []
            for name, body in zip(batch.column("item").to_pylist(), texts(batch, "body")):
                found = [w.decode() for w in words(body)]
                last = max(len(found) - window, 0) if found else -1
                rows += [(name, found[i: i + window]) for i in range(last + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))],
                ["item", "terms"])

    named = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("body"))
    return named.mapInArrow(cut, "item string, terms array<string>").select(
        F.xxhash64("terms").alias("phrase"), "terms", "item").distinct()


def _shards(entries: Iterator[tuple[tuple, list[bytes]]], limit: int, gap: int):
    """Groups documents into shards of about ``limit`` places: words, and a gap behind each document."""
    held, size = [], 0
    for entry in entries:
        held.append(entry)
        size += len(entry[1]) + gap
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def index(docs: DataFrame, vocabulary: list[str], text: str = "text", shard_words: int = SHARD_WORDS,
          gap: int = WINDOW) -> DataFrame:
    """The index of ``docs``. Rows with a ``term`` hold its ``places``; the row of a shard with a null term holds its
    documents: ``ids``, ``k1, k2`` (the row keys), ``starts`` and ``sizes``."""
    k1, k2 = row_key("doc_id", text)
    shared = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(vocabulary)})

    def build(batches):
        number = {**shared.value}.get
        names = np.array(vocabulary, dtype=object)

        def entries():
            for batch in batches:
                keys = zip(*[batch.column(c).to_pylist() for c in ("id", "k1", "k2")])
                yield from zip(keys, map(words, texts(batch, text)))

        part = TaskContext.get().partitionId() << 32
        for name, shard in enumerate(_shards(entries(), shard_words, gap), part):
            sizes = np.array([len(w) for _, w in shard], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
            terms, places = [], []
            for (_, found), start in zip(shard, starts.tolist()):
                ids = np.fromiter((number(w, -1) for w in found), np.int32, len(found))
                at = np.flatnonzero(ids >= 0)
                terms.append(ids[at])
                places.append(at + start)
            terms, places = np.concatenate(terms), np.concatenate(places)
            order = np.argsort(terms, kind="stable")
            terms, places = terms[order], places[order]
            edges = np.flatnonzero(np.diff(terms, prepend=-1))
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(edges, len(terms)), pa.int32()), pa.array(places, pa.int64()))
            ids, first, second = zip(*[key for key, _ in shard])
            count = len(edges)
            empty = pa.array([None] * count, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * (count + 1), pa.int64()),
                pa.array([*names[terms[edges]], None], pa.string()),
                pa.concat_arrays([lists, pa.array([None], pa.list_(pa.int64()))]),
                *[pa.concat_arrays([empty, pa.array([list(values)], pa.list_(pa.int64()))]) for values in (
                    ids, first, second, starts, sizes)],
            ], ["shard", "term", "places", "ids", "k1", "k2", "starts", "sizes"])

    lists = "array<bigint>"
    return docs.select(F.col("doc_id").cast("long").alias("id"), k1, k2, text).mapInArrow(
        build, f"shard bigint, term string, places {lists}, ids {lists}, k1 {lists}, k2 {lists}, starts {lists}, sizes {lists}")


def find(lists: dict, phrase: list[tuple[str, int]], slop: int = 0) -> np.ndarray:
    """Places where a phrase begins. ``phrase`` holds its terms with their offsets, the rarest first."""
    left = None
    for term, offset in phrase:
        places = lists.get(term)
        if places is None:
            return np.empty(0, np.int64)
        if left is None:
            left = places - offset
            continue
        wanted = left + offset
        at = np.searchsorted(places, wanted - slop)
        at[at == len(places)] = len(places) - 1
        left = left[np.abs(places[at] - wanted) <= slop]
        if not left.size:
            break
    return left if left is not None else np.empty(0, np.int64)


def matches(stored: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """For every indexed document ``doc_id, k1, k2, n_words``, ``places`` (its words inside a phrase) and ``phrases``,
    the numbers of those that occur.

    ``wanted`` are phrases whose number is bounded by the caller; they are broadcast with their terms in order of
    rarity. A shard is the unit of work and bounded by its number of words; it tries the phrases whose rarest term it has.
    """
    spark = stored.sparkSession
    rare = stored.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    offsets = wanted.select("phrase", F.posexplode("terms").alias("offset", "term"))
    # No more terms than the block has words; a common term stands in many phrases, which a join by term would gather.
    ordered = offsets.join(F.broadcast(rare), "term", "left").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "term"))).alias("t"))
    # Of one phrase there are as many terms as it is long, so this list is as long as the phrases are.
    by_rarest: dict[str, list] = {}
    for row in ordered.where(F.get("t", F.lit(0))["df"] > 0).collect():
        by_rarest.setdefault(row.t[0].term, []).append((row.phrase, [(t.term, t.offset) for t in row.t]))
    reach = max((len(terms) for held in by_rarest.values() for _, terms in held), default=0) + slop
    shared = spark.sparkContext.broadcast(by_rarest)

    def search(shard: pa.Table) -> pa.Table:
        lists, documents = {}, []
        for row, (term, places) in enumerate(zip(shard["term"].to_pylist(), shard["places"])):
            if term is None:
                documents.append(row)
            else:
                lists[term] = places.values.to_numpy()
        (row,) = documents
        ids, first, second, starts, sizes = (
            shard[c][row].values for c in ("ids", "k1", "k2", "starts", "sizes"))
        starts, sizes = starts.to_numpy(), sizes.to_numpy()
        edges = np.zeros(int(starts[-1] + sizes[-1]) + reach + 1, np.int32)
        seen: dict[int, list] = {}
        for phrase, terms in (held for term in lists for held in shared.value.get(term, ())):
            found = find(lists, terms, slop)
            if found.size:
                np.add.at(edges, found, 1)
                np.add.at(edges, found + len(terms), -1)
                for d in np.unique(np.searchsorted(starts, found, "right") - 1).tolist():
                    seen.setdefault(d, []).append(phrase)
        inside = np.flatnonzero(np.cumsum(edges) > 0)
        cuts = zip(np.searchsorted(inside, starts).tolist(), np.searchsorted(inside, starts + sizes).tolist(), starts)
        return pa.table({
            "doc_id": ids, "k1": first, "k2": second, "n_words": pa.array(sizes),
            "places": pa.array([inside[a:b] - start for a, b, start in cuts], pa.list_(pa.int64())),
            "phrases": pa.array([seen.get(d, []) for d in range(len(sizes))], pa.list_(pa.int64()))})

    return stored.groupBy("shard").applyInArrow(
        search, "doc_id long, k1 long, k2 long, n_words long, places array<bigint>, phrases array<bigint>")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, text: str = "text",
         block: int = TERMS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, k1, k2, n_words, n_hit, items``. The test set is searched in blocks."""
    owned = written(phrases(benchmark, window, text=text), "phrases")
    wanted = written(owned.select("phrase", "terms").distinct(), "distinct-phrases")
    (total,) = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-total // block))
    found = []
    for number in range(blocks):
        part = wanted.where(F.pmod("phrase", F.lit(blocks)) == number)
        vocabulary = sorted(r.term for r in part.select(F.explode("terms").alias("term")).distinct().collect())
        stored = written(index(docs, vocabulary, text, gap=window + slop), "postings")
        found.append(written(matches(stored, part, slop), "matches"))
    every = found[0]
    if blocks > 1:
        # Equal rows share a key and a result: each block brings one row a key, however many copies there are.
        key = ["doc_id", "k1", "k2"]
        once = [part.groupBy(*key).agg(
            *[F.first(c).alias(c) for c in ("n_words", "places", "phrases")], F.count("*").alias("n")) for part in found]
        union = lambda column: F.array_distinct(F.flatten(F.collect_list(column))).alias(column)
        merged = reduce(DataFrame.unionByName, once).groupBy(*key).agg(
            F.max("n_words").alias("n_words"), union("places"), union("phrases"), F.max("n").cast("int").alias("n"))
        every = written(merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), "merged-matches")
    owners = owned.where("item IS NOT NULL").select("phrase", "item")
    items = every.select("k1", "k2", F.explode("phrases").alias("phrase")).distinct().join(owners, "phrase").groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return every.join(items, ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", "n_words", F.size("places").cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without a hit."""
    k1, k2 = row_key("doc_id", text)
    bad = hits(docs, benchmark, window, text=text).where("n_hit > 0").select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    return keyed.join(written(bad, "contaminated"), ["_k1", "_k2"], "left_anti").drop("_k1", "_k2")
