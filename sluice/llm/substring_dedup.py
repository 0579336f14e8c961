"""Substring dedup with suffix automata of reference shards.

Every window of ``WINDOW`` words belongs to one anchor, the least hashed ``GRAM``-word phrase in it, and equal windows
have equal anchors. A run of windows with one anchor is a region. Only regions whose anchor occurs again can hold a
repeated window. Equal regions are counted, not compared. What is left, different regions around one anchor, is dealt to
reference shards by anchor: a shard builds a suffix automaton of its regions, streams each region through it for its
matching statistics, and reports the stretches whose windows occur in another region. The documents' regions are routed
to the shard of their anchor instead of broadcasting all automata, because the references grow with the corpus.
Anchors with more than ``CROWDED`` different regions go by the hash of each window, so that no task holds them together.

Defined results: null and empty texts, and texts shorter than a window, lose nothing; repeated rows repeat their windows
and lose them all; ids may be null or repeated; other columns pass through ``dedup``.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import row_key, texts, written

WINDOW = 35
GRAM = 8
CROWDED = 2_000
SHARD_REGIONS = 4_000
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
AT = 32  # a region's first window is kept above this bit, its last below


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    if n:
        powers[0] = 1
    return np.multiply.accumulate(powers)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def regions_of(words: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Anchor, hash, first and last window of each region of a text of ``window`` words or more."""
    hashes = _hashes(words)
    n = len(hashes)
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(MULTIPLIER) + hashes[k: n - gram + 1 + k]
    grams = _mixed(grams)
    width = window - gram + 1
    lowest = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.diff(lowest, prepend=-1))
    last = np.append(first[1:], n - window + 1) - 1
    # A hash of words first..last+window-1 that does not depend on where they stand.
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_mixed(hashes) * _powers(MULTIPLIER, n))])
    length = (last + window - first).astype(np.uint64)
    content = (sums[last + window] - sums[first]) * _powers(INVERSE, n)[first] + length
    return grams[lowest[first]], _mixed(content), first, last


def regions(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``anchor, content, k1, k2, at``: a row per region; ``at`` packs its first and last window."""
    names = ["anchor", "content", "k1", "k2", "at"]

    def run(batches):
        for batch in batches:
            k1, k2, bodies = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), texts(batch, text)
            found = []
            for row, body in enumerate(bodies):
                words = body.split()  # bytes: ASCII white space only
                if len(words) >= window:
                    anchor, content, first, last = regions_of(words, window, gram)
                    found.append((np.full(len(first), row), anchor.view(np.int64), content.view(np.int64),
                                  first << AT | last))
            if found:
                rows, anchor, content, at = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (anchor, content, k1[rows], k2[rows], at)], names)

    return docs.select(*row_key("doc_id", text), text).mapInArrow(
        run, "anchor long, content long, k1 long, k2 long, at long")


class SuffixAutomaton:
    """Of several sequences; ``counts`` tells at how many places the strings of a state end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.counts = [-1], [0], [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.counts[self.link[state]] += self.counts[state]

    def _state(self, following: dict[int, int], link: int, length: int, count: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.counts.append(count)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, child: int) -> int:
        """The state of the string that ``symbol`` makes after ``state``'s longest."""
        if self.length[child] == self.length[state] + 1:
            return child
        clone = self._state(dict(self.next[child]), self.link[child], self.length[state] + 1, 0)
        self.link[child] = clone
        while state >= 0 and self.next[state].get(symbol) == child:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:  # from an earlier sequence
            reached = self._split(last, symbol, known)
            self.counts[reached] += 1
            return reached
        new, state = self._state({}, 0, self.length[last] + 1, 1), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol, self.next[state][symbol])
        return new

    def repeated(self, sequence: list[int], window: int) -> list[int]:
        """Starts of windows of a sequence that the automaton holds at two places or more."""
        state, matched, found = 0, 0, []
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.counts[state] >= 2:
                found.append(end - window)
        return found


def runs(starts: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as stretches (first, last)."""
    found: list[tuple[int, int]] = []
    for s in starts:
        if found and found[-1][1] == s - 1:
            found[-1] = (found[-1][0], s)
        else:
            found.append((s, s))
    return found


SPANS = "k1 long, k2 long, at long"


def _spans(rows: list[tuple[int, int, int]]) -> pa.Table:
    k1, k2, at = zip(*rows) if rows else ((), (), ())
    return pa.table({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "at": pa.array(at, pa.int64())})


def _by_automaton(compared: DataFrame, shards: int, window: int) -> DataFrame:
    """Rows ``anchor, content, k1, k2, at, n, words``, distinct by anchor and content, to stretches of repeated windows."""
    def shard(table: pa.Table) -> pa.Table:
        found = []
        rows = sorted(table.drop_columns("shard").to_pylist(), key=lambda r: (r["anchor"], r["content"]))
        for _, group in groupby(rows, key=lambda r: r["anchor"]):
            group = [next(same) for _, same in groupby(group, key=lambda r: r["content"])]
            symbols: dict[str, int] = {}
            sequences = [[symbols.setdefault(w, len(symbols)) for w in r["words"].split(" ")] for r in group]
            automaton = SuffixAutomaton(sequences)
            for row, sequence in zip(group, sequences):
                if row["n"] == 1:  # else the whole region is repeated
                    first = row["at"] >> AT
                    found += [(row["k1"], row["k2"], first + a << AT | first + b)
                              for a, b in runs(automaton.repeated(sequence, window))]
        return _spans(found)

    return compared.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(
        shard, SPANS)


def _by_window(compared: DataFrame, window: int) -> DataFrame:
    """The same for crowded anchors: their windows are counted one by one."""
    def cut(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words, first = row["words"].encode().split(b" "), row["at"] >> AT
                for i in range(len(words) - window + 1):
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words[i: i + window]))
                    rows.append((digest >> 64, digest & (1 << 64) - 1, row["k1"], row["k2"], first + i, row["n"]))
            if rows:
                w1, w2, *others = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.array(w, np.uint64).view(np.int64)) for w in (w1, w2)),
                     *(pa.array(c, pa.int64()) for c in others)], ["w1", "w2", "k1", "k2", "start", "n"])

    windows = written(compared.mapInArrow(
        cut, "w1 long, w2 long, k1 long, k2 long, start long, n long"), "crowded-windows")
    repeated = written(
        windows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2"), "repeated-windows")
    start = F.col("start")
    return windows.where("n = 1").join(repeated, ["w1", "w2"]).select(
        "k1", "k2", F.shiftleft(start, AT).bitwiseOR(start).alias("at"))


def _with_words(chosen: DataFrame, docs: DataFrame, text: str, window: int) -> DataFrame:
    """Puts the words of its region beside each row of ``chosen``; a text is read once for all its rows."""
    names = ["anchor", "content", "n", "different", "at"]
    lists = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("chosen"))
    keyed = docs.select(*row_key("doc_id", text), text).join(lists, ["k1", "k2"])

    def cut(batches):
        for batch in batches:
            keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
            for (k1, k2), body, wanted in zip(keys, texts(batch, text), batch.column("chosen").to_pylist()):
                words = body.split()
                rows = [[r[c] for r in wanted] for c in names]
                spans = [b" ".join(words[at >> AT: (at & (1 << AT) - 1) + window]).decode() for at in rows[-1]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in rows), pa.array([k1] * len(spans), pa.int64()),
                     pa.array([k2] * len(spans), pa.int64()), pa.array(spans, pa.string())], [*names, "k1", "k2", "words"])

    return keyed.mapInArrow(cut, ", ".join(f"{c} long" for c in [*names, "k1", "k2"]) + ", words string")


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   crowded: int = CROWDED, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """Row keys with ``at``, first and last start of a stretch of windows that also occur elsewhere."""
    every = written(regions(docs, text, window, gram), "regions")
    # What has been counted is written before it is joined: of two read sides AQE splits a hot key, or broadcasts a small one.
    again = written(
        every.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor"), "repeated-anchors")
    candidates = written(every.join(again, "anchor"), "candidates")
    counted = written(
        candidates.groupBy("anchor", "content").agg(
            F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("at").alias("at")),
        "counted-regions")
    whole = candidates.join(counted.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select(
        "k1", "k2", "at")
    different = written(
        counted.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1"), "anchors-of-several")
    compared = written(_with_words(counted.join(different, "anchor"), docs, text, window), "compared-regions")
    few = compared.where(F.col("different") <= crowded)
    shards = max(1, -(-few.count() // shard_regions))
    return whole.unionByName(_by_automaton(few, shards, window)).unionByName(
        _by_window(compared.where(F.col("different") > crowded), window))


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, **settings) -> DataFrame:
    """``docs`` with the words of repeated windows taken out of ``text``, and ``n_words``, ``n_removed``.

    A text is rebuilt from its words, joined by one space.
    """
    # Equal rows share a key and so their stretches, each of which is kept once.
    spans = repeated_spans(docs, text, window, **settings).groupBy("k1", "k2").agg(
        F.collect_set("at").alias("_spans")).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    k1, k2 = row_key("doc_id", text)
    keyed = docs.withColumns({"_k1": k1, "_k2": k2}).join(spans, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed")]

    def rebuild(batches):
        for batch in batches:
            left, totals, removed = [], [], []
            for body, stretches in zip(texts(batch, text), batch.column("_spans").to_pylist()):
                words = body.split()
                if stretches:
                    edges = np.zeros(len(words) + 1, np.int32)
                    at = np.array(stretches, np.int64)
                    np.add.at(edges, at >> AT, 1)
                    np.add.at(edges, (at & (1 << AT) - 1) + window, -1)
                    keep = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
                    kept = [words[i] for i in keep]
                else:
                    kept = words
                left.append(b" ".join(kept).decode())
                totals.append(len(words))
                removed.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(left, pa.string()), pa.array(totals, pa.int64()),
                 pa.array(removed, pa.int64())], [*others, text, "n_words", "n_removed"])

    empty = F.lit(0).cast("long")
    schema = docs.select(*others, text, empty.alias("n_words"), empty.alias("n_removed")).schema
    return keyed.mapInArrow(rebuild, schema)
