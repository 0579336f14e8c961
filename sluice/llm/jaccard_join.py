"""N-gram Jaccard join: T-occurrence search by DivideSkip over shards in which every linked pair meets.

A text's set holds the hashes of its shingles. Texts of one set are one node from the start. Two sets of ``n`` and ``m``
shingles link when they share ``T = p (n + m) / (p + q)`` of them for a similarity of ``p / q``.

**Shards.** Sets of similar size share a band; a band cuts the space of hashes into segments, a few more than shingles
may differ in a linked pair. So a linked pair agrees on at least ``spare + 1`` whole segments, and still on one after each
set has left out its ``spare`` smallest segments. A node stands in the list of each segment that it keeps. No frequent
shingle makes a list long: a list holds only sets that agree on all of a segment, some ten shingles.

**Search.** In a shard the sets are an inverted index: for every shingle the list of sets that have it. A query puts its
longest lists aside (``DivideSkip``: as many as its ``T`` and the longest list say), merges the short ones by counting
(numpy counts what a heap would pop one by one), and keeps the sets that occur often enough to reach ``T`` with the long
lists; these are then probed by binary search, and the exact overlap decides.

First every list is a shard with one query, its least node, so that a large group of near copies is joined by as many
comparisons as it has nodes. Only lists that then still hold several groups are searched whole, those with the same
largest group as one, and all nodes but those of that group are queries; crowded lists are cut into parts by weight, and
pairs of parts of one group are left out.

Defined results: texts without words (null too) have an empty set and are linked with nothing; of fewer words than a
shingle all are one shingle; ids may repeat or be null (a group whose ids are all null has a null component; a text
without words has its own id); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import row_key, texts, written
from sluice.llm.components import components

WORDS = 3
SEED = 42
SIMILAR = (9, 10)
TILE = 1 << 20  # shingles of a part
PROBES = 1 << 22
SKIP = 0.01  # weight of a probe of a long list against a step of the merge (DivideSkip's mu)
LEAST_BAND, BAND_GROWTH = 1, 1.5
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, 7, np.uint64) | np.uint64(1)
_SHIFT = np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> _SHIFT)


def shingle_set(words: list[bytes], known: dict[bytes, int], width: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; ``known`` remembers the hashes of words."""
    if not words:
        return np.empty(0, np.uint64)
    for word in words:
        if word not in known:
            known[word] = xxhash.xxh64_intdigest(word, SEED)
    hashes = np.array([known[w] for w in words], np.uint64)
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = total * _MIX[2] + _mixed(hashes[i: len(words) - width + 1 + i] + _MIX[3])
    return np.unique(_mixed(total))


class Bands:
    """Bands of set sizes and the segments of each, for a similarity of ``part / whole``."""

    def __init__(self, similar: tuple[int, int] = SIMILAR):
        self.part, self.whole = similar
        bounds = [LEAST_BAND]
        while bounds[-1] < 1 << 40:
            # A set reaches at most one band down: bands are wider than what sizes of a linked pair differ by.
            wide = self.whole * bounds[-1] // self.part + 1
            bounds.append(max(wide, int(bounds[-1] * BAND_GROWTH)))
        self.bounds = bounds

    def of(self, n: int) -> list[int]:
        """Bands in which a set of ``n`` shingles has partners: its own, and the one below if partners may lie there."""
        band = int(np.searchsorted(self.bounds, n, "right")) - 1
        least = -(-self.part * n // self.whole)
        return [band, band - 1] if band and least < self.bounds[band] else [band]

    def differing(self, band: int) -> int:
        """Shingles in which a linked pair of the band may differ at most."""
        small = self.bounds[band + 1] - 1
        large = self.whole * small // self.part
        return (small + large) * (self.whole - self.part) // (self.whole + self.part)

    def keys(self, held: np.ndarray) -> np.ndarray:
        """One key for each segment that a set keeps, over its bands; none for sets that only equal ones link with."""
        n, found = len(held), []
        if not n or self.whole * n // self.part == n and -(-self.part * n // self.whole) == n and not self._one_apart(n):
            return np.empty(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(held ^ _MIX[4]))])
        for band in self.of(n):
            kept = self.differing(band) + 1
            spare = max(1, kept // 6)
            # Segments are ranges of the hash: a sorted set holds each as a slice.
            segment = ((held >> _SHIFT) * np.uint64(kept + spare)) >> _SHIFT
            ends = np.searchsorted(segment, np.arange(1, kept + spare + 1, dtype=np.uint64))
            starts = np.concatenate([[0], ends[:-1]])
            chosen = np.argsort(ends - starts, kind="stable")[spare:]  # ties by the segment, so that partners agree
            total = sums[ends[chosen]] - sums[starts[chosen]]
            found.append(_mixed(total * _MIX[5] + (chosen + (band << 48)).astype(np.uint64) * _MIX[6]))
        return np.concatenate(found)

    def _one_apart(self, n: int) -> bool:
        """Whether different sets of ``n`` shingles can link."""
        return (n - 1) * self.whole >= self.part * (n + 1)


class Index:
    """Inverted lists over sets; ``reaching`` is the T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR):
        self.part, self.whole = similar
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.shingles, self.starts = np.unique(shingles[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(shingles))
        self.places = np.repeat(np.arange(len(self.shingles)), self.ends - self.starts) * len(sets) + self.owners

    def reaching(self, query: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The sets among ``wanted`` (a mask) that are similar to the query."""
        least = -(-self.part * len(query) // self.whole)
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        lists = at[self.shingles[at] == query]
        if len(lists) < least:
            return np.empty(0, np.int64)
        lengths = self.ends[lists] - self.starts[lists]
        by_length = np.argsort(-lengths, kind="stable")
        aside = min(least - 1, int(least / (SKIP * np.log2(max(2, lengths.max())) + 1)))
        long, short = lists[by_length[:aside]], lists[by_length[aside:]]
        spans = self.ends[short] - self.starts[short]
        steps = np.arange(spans.sum()) + np.repeat(self.starts[short] - np.cumsum(spans) + spans, spans)
        counts = np.bincount(self.owners[steps], minlength=len(self.sizes))
        found = np.flatnonzero((counts >= least - aside) & wanted)
        overlap = counts[found]
        chunk = max(1, PROBES // max(1, len(found)))
        for i in range(0, len(long) if len(found) else 0, chunk):
            probes = long[i: i + chunk, None] * len(self.sizes) + found[None, :]
            spot = np.minimum(np.searchsorted(self.places, probes), len(self.places) - 1)
            overlap = overlap + (self.places[spot] == probes).sum(axis=0)
        union = len(query) + self.sizes[found] - overlap
        return found[self.whole * overlap >= self.part * union]


def marks(docs: DataFrame, width: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id, k1, k2, text`` to ``doc_id, k1, k2``, ``node`` (equal for equal sets, null for empty ones), ``n`` and ``keys``."""
    def run(batches):
        bands = Bands(similar)
        for batch in batches:
            known, nodes, sizes, keys = {}, [], [], []
            for text in texts(batch):
                held = shingle_set(text.lower().split(), known, width)  # bytes: A-Z and ASCII white space only
                nodes.append(xxhash.xxh64_intdigest(held.tobytes(), SEED) - (1 << 63) if len(held) else None)
                sizes.append(len(held))
                keys.append(bands.keys(held).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "k1", "k2")], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "node", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(
        run, f"doc_id {kind}, k1 long, k2 long, node long, n long, keys array<long>")


def _sets(found: DataFrame, width: int) -> DataFrame:
    """``node, text`` to ``node, held``: the set as bytes."""
    def run(batches):
        for batch in batches:
            known = {}
            held = [shingle_set(t.lower().split(), known, width).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(held, pa.binary())], ["node", "held"])

    return found.mapInArrow(run, "node long, held binary")


def _tiles(batches, columns):
    """Rows in the order of their tile, as lists of one tile each."""
    tile, rows = None, []
    for batch in batches:
        for t, *row in zip(*[batch.column(c).to_pylist() for c in ("tile", *columns)]):
            if t != tile and rows:
                yield rows
                rows = []
            tile = t
            rows.append((*row[:-1], np.frombuffer(row[-1], np.uint64)))
    if rows:
        yield rows


def _edges(pairs: list[tuple[int, int]]):
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _stars(members: DataFrame, sets: DataFrame, similar: tuple[int, int], tile: int) -> DataFrame:
    """Edges from nodes to the least node of one of their lists."""
    arms = members.where("node <> lead").select("lead", "node", "n").distinct()
    sized = arms.groupBy("lead").agg(F.ceil(F.sum("n") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    dealt = arms.join(sized, "lead").select("lead", "node", part.alias("part"))
    leads = sized.select("lead", F.col("lead").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = dealt.unionByName(leads).join(sets, "node").select(
        F.xxhash64("lead", "part").alias("tile"), (F.col("node") != F.col("lead")).alias("arm"), "node", "held")

    def run(batches):
        for (_, lead, query), *others in _tiles(batches, ("arm", "node", "held")):
            if others:
                found = Index([held for _, _, held in others], similar).reaching(query, np.ones(len(others), bool))
                yield _edges([(others[i][1], lead) for i in found.tolist()])

    return rows.repartition("tile").sortWithinPartitions("tile", "arm").mapInArrow(run, "a long, b long")


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, similar: tuple[int, int], tile: int) -> DataFrame:
    """Edges inside lists that hold several groups, enough to join whatever is similar there."""
    rooted = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("key", "root").agg(F.count("*").alias("nodes"))
    crowded = groups.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum("nodes").alias("nodes"),
        F.max(F.struct("nodes", "root"))["root"].alias("hub"),
    ).where("low <> high AND nodes > 2").select("key", "hub")  # of two nodes one was the query
    # Copies share many lists: those of one largest group are one list, in which a node stands once.
    joined = written(rooted.join(crowded, "key").select(F.col("hub").alias("key"), "node", "n", "root").distinct(), "join-hubs")
    weights = joined.groupBy("key", "root").agg(F.sum("n").alias("weight"))
    light = weights.groupBy("key").agg(F.sum(F.when(F.col("weight") <= tile, F.col("weight")).otherwise(0)).alias("light"))
    large = F.col("weight") > tile
    part = F.when(large, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("weight") / tile)))).otherwise(
        F.xxhash64(F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), F.ceil(F.col("light") / tile)))))
    dealt = written(
        joined.join(weights.join(light, "key"), ["key", "root"]).select(
            "key", "node", "root", part.alias("part"), F.when(large, F.col("root")).alias("own")), "join-crowded")
    parts = dealt.select("key", "part", "own").distinct()
    others = parts.select("key", F.col("part").alias("other"), F.col("own").alias("others_own"))
    pairs = parts.join(others, "key").where("part <= other AND (own IS NULL OR others_own IS NULL OR own <> others_own)").select(
        "key", F.xxhash64("key", "part", "other").alias("tile"), F.explode(F.array_distinct(F.array("part", "other"))).alias("part"))
    rows = dealt.join(pairs, ["key", "part"]).join(sets, "node").select("tile", "node", "root", "held")

    def run(batches):
        for group in _tiles(batches, ("node", "root", "held")):
            root = np.array([r for _, r, _ in group], np.int64)
            names, counts = np.unique(root, return_counts=True)
            index, pairs = Index([held for _, _, held in group], similar), []
            for i in np.flatnonzero(root != names[counts.argmax()]).tolist():
                for j in index.reaching(group[i][-1], root != root[i]).tolist():
                    if root[j] != root[i]:
                        pairs.append((group[i][0], group[j][0]))
                        root[root == root[i]] = root[j]
            yield _edges(pairs)

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct()


def lists(marked: DataFrame) -> DataFrame:
    """Members ``key, node, n, lead`` of the lists that hold several nodes; of lists with the same members one stays."""
    postings = marked.select("node", "n", F.explode("keys").alias("key"))
    sums = [F.sum(F.shiftrightunsigned(c, 33)).alias(f"s{i}") for i, c in enumerate([F.col("node"), F.xxhash64("node")])]
    shared = postings.groupBy("key").agg(
        F.count("*").alias("c"), F.min("node").alias("lead"), F.max("node").alias("last"), *sums).where("lead <> last")
    chosen = shared.groupBy("lead", "last", "c", "s0", "s1").agg(F.min("key").alias("key")).select("key", "lead")
    return postings.join(chosen, "key").select("key", "node", "n", "lead").distinct()


def near_groups(docs: DataFrame, width: int = WORDS, similar: tuple[int, int] = SIMILAR, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``n`` (the size of the set) and ``component_id``, the least id that links lead to."""
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), "text")
    marked = written(marks(keyed, width, similar), "join-marks")
    members = written(lists(marked), "join-lists")
    nodes = marked.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("k1", "k2")).alias("row"))
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "row.k1", "row.k2")
    held = keyed.join(wanted, ["k1", "k2"]).groupBy("k1", "k2", "node").agg(F.first("text").alias("text"))  # repeated rows
    sets = written(_sets(held.select("node", "text"), width), "join-sets")
    stars = components(_stars(members, sets, similar, tile))
    more = written(_rest(members, stars, sets, similar, tile), "join-rest")
    found = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = written(
        nodes.join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "join-groups")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    return marked.select("doc_id", "n", "node").join(named, "node", "left").select(
        "doc_id", "n", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
