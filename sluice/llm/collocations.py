"""Phrase collocations: word n-grams counted in counting quotient filters, scored by their weakest cut.

Words of at least ``LEAST`` occurrences get dense ids, the frequent ones first, per language. Texts are encoded as ids with
breaks where a piece ends or a rarer word stands: no phrase over a break can be frequent. An n-gram's ids are packed into
two halves of a fixed number of bits; an invertible permutation (a Feistel network) spreads the packed values evenly. Its
leading bits are the quotient, the rest is kept whole as the remainder, so a counter stands for one n-gram exactly.

Every task sorts the permuted n-grams of a chunk and emits one filter per shard, a range of quotients: how many remainders
each quotient has, the remainders in as few bytes as they need, and counters of one byte with an overflow list. A shard
merges its sorted filters by adding the counters of equal entries; hot n-grams are one entry in each filter, so no shard is
larger than others. The number of shards follows from the number of words.

Pairs are counted first. A bitmap of fixed size marks the slots of frequent pairs; triples and quadruples are counted only
where all their pairs are marked (none that is frequent is missed, as each of its pairs is frequent too). The dictionary
is broadcast while it has at most ``BROADCAST_WORDS`` words; beyond that each text is joined with the ids of its own words.

Defined results: null texts are empty; a null language is ``und``; repeated rows count as often as they stand; ties of the
score go to the smallest cut; texts without frequent phrases and empty tables have no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import texts, written
from sluice.llm.places import numbered

LEAST = 30
LONGEST = 4
HOLDING = 80  # per cent: so often a phrase must stand inside a longer one to be dropped
SCALE = 2_000_000
TOP = 2000
UNKNOWN_LANG = "und"
BROADCAST_WORDS = 1 << 20
CHUNK = 1 << 22  # n-grams sorted at once
SHARD_WORDS = 1 << 22
DISTINCT_WORDS = 500_000
PAIR_SLOTS = 24  # bits
SALTS = 256
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Separators of pieces become breaks, white space inside pieces becomes a blank.
_PIECES = bytes(0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with ``\\n`` between pieces; empty tokens mean nothing."""
    return text.lower().translate(_PIECES).replace(b"\n", b" \n ").split(b" ")


# Word counts and ids

def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` over all words of ``lang, text``."""
    def run(batches):
        counts = {}

        def flushed():
            rows = [(lang, word.decode(), f) for lang, held in counts.items() for word, f in held.items() if word not in (b"", b"\n")]
            counts.clear()
            langs, words, numbers = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                counts.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, counts.values())) > DISTINCT_WORDS:
                    yield flushed()
        yield flushed()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """``lang, word, f, id`` of the frequent words, ids from 1."""
    frequent = counts.where(F.col("f") >= least)
    return numbered(frequent, [F.col("f").desc(), "lang", "word"], "id").withColumn("id", F.col("id") + 1)


# Encoding

def _encoded(ids: np.ndarray) -> np.ndarray:
    """Without empty tokens (-1), words between two breaks and repeated breaks."""
    ids = ids[ids >= 0]
    filled = ids > 0
    before, after = np.concatenate([[False], filled[:-1]]), np.concatenate([filled[1:], [False]])
    ids = np.where(filled & ~before & ~after, 0, ids)
    filled = ids > 0
    return ids[filled | np.concatenate([[False], filled[:-1]])]


def encode(docs: DataFrame, words: DataFrame, size: int, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``lang, text`` to ``ids``: little-endian unsigned integers of four bytes, 0 for breaks."""
    if size <= broadcast_words:
        known = {}
        for row in words.select("lang", "word", "id").collect():  # broadcast_words rows at most
            known.setdefault(row.lang, {})[row.word.encode()] = row.id
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def lookups(batch):
            for lang in batch.column("lang").to_pylist():
                yield shared.value.get(lang, {})

        source = docs.select("lang", "text")
    else:
        def own_words(batches):
            for batch in batches:
                rows = [(row, lang, w.decode()) for row, lang, text in zip(
                    batch.column("row").to_pylist(), batch.column("lang").to_pylist(), texts(batch))
                    for w in set(tokens(text)) if w not in (b"", b"\n")]
                for i in range(0, len(rows), 100_000):
                    row, lang, word = zip(*rows[i: i + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row, pa.int64()), pa.array(lang, pa.string()), pa.array(word, pa.string())], ["row", "lang", "word"])

        held = written(docs.select("lang", "text").withColumn("row", F.monotonically_increasing_id()), "phrase-texts")
        named = held.mapInArrow(own_words, "row long, lang string, word string").join(words, ["lang", "word"])
        listed = named.groupBy("row").agg(F.collect_list(F.struct("word", "id")).alias("known"))  # words of one text
        source = held.join(listed, "row").select("known", "text")

        def lookups(batch):
            for known in batch.column("known").to_pylist():
                yield {x["word"].encode(): x["id"] for x in known}

    def run(batches):
        for batch in batches:
            out = []
            for known, text in zip(lookups(batch), texts(batch)):
                get = known.get
                ids = np.array([get(w, 0) if w else -1 for w in tokens(text)], np.int64)
                out.append(_encoded(ids).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return source.mapInArrow(run, "ids binary").where(F.octet_length("ids") > 0)


# Quotient filters

def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _round(half: np.ndarray, factor: int, bits: int) -> np.ndarray:
    h = (half + np.uint64(1)) * np.uint64(factor)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_ROUNDS[0])
    return (h >> np.uint64(64 - bits)) & _low(bits)


def permuted(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An invertible permutation of pairs of halves of ``bits`` bits each."""
    for factor in _ROUNDS:
        left, right = right, left ^ _round(right, factor, bits)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for factor in reversed(_ROUNDS):
        left, right = right ^ _round(left, factor, bits), left
    return left, right


def _summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, equal ones as one with the sum of their counts."""
    if not len(left):
        return left, right, counts
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[starts], right[starts], np.add.reduceat(counts, starts)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values_of(data: memoryview, count: int, width: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, count * width).reshape(count, width)
    return wide.view("<u8").ravel()


def packed(left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: int, quotient_bits: int) -> bytes:
    """A filter of sorted entries: ``quotient_bits`` of ``left`` as occupancy, all other bits as remainders."""
    rest = bits - quotient_bits
    quotients = (left >> np.uint64(rest)).astype(np.int64)
    first = int(quotients[0])
    occupied = np.bincount(quotients - first)
    wide = 1 if occupied.max() < 1 << 8 else 2 if occupied.max() < 1 << 16 else 4
    over = counts >= 255
    head = np.array([len(left), first, len(occupied), wide, rest, int(over.sum())], "<i8").tobytes()
    return b"".join([
        head, occupied.astype(f"<u{wide}").tobytes(), _bytes_of(left & _low(rest), -(-rest // 8)),
        _bytes_of(right, -(-bits // 8)), np.where(over, 255, counts).astype(np.uint8).tobytes(), counts[over].astype("<i8").tobytes()])


def unpacked(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(data)
    count, first, length, wide, rest, over = np.frombuffer(data[:48], "<i8").tolist()
    at = 48 + length * wide
    occupied = np.frombuffer(data[48:at], f"<u{wide}").astype(np.int64)
    quotients = np.repeat(np.arange(first, first + length, dtype=np.uint64), occupied)
    width = -(-rest // 8)
    left = (quotients << np.uint64(rest)) | _values_of(data[at:], count, width)
    at += count * width
    right = _values_of(data[at:], count, -(-bits // 8))
    at += count * -(-bits // 8)
    counts = np.frombuffer(data[at: at + count], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[at + count:], "<i8", over)
    return left, right, counts


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The slot of a pair of ids in the bitmap."""
    both = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    return ((both * np.uint64(_ROUNDS[1])) ^ (both >> np.uint64(17)) * np.uint64(_ROUNDS[2])) >> np.uint64(64 - PAIR_SLOTS)


def _pairs(ids: np.ndarray, bits: int, marked) -> tuple[np.ndarray, np.ndarray]:
    both = (ids[:-1] > 0) & (ids[1:] > 0)
    return ids[:-1][both], ids[1:][both]


def _longer(ids: np.ndarray, bits: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the triples and quadruples whose pairs are all marked."""
    both = (ids[:-1] > 0) & (ids[1:] > 0)
    slots = _slots(ids[:-1], ids[1:])
    both &= (marked[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
    b = np.uint64(bits)
    three, four = np.flatnonzero(both[:-1] & both[1:]), np.flatnonzero(both[:-2] & both[1:-1] & both[2:])
    left = [ids[at] << b | ids[at + 1] for at in (three, four)]
    right = [ids[three + 2] << b, ids[four + 2] << b | ids[four + 3]]
    return np.concatenate(left), np.concatenate(right)


def count_grams(encoded: DataFrame, grams, bits: int, half: int, shards: int, least: int, marked=None,
                chunk: int = CHUNK) -> DataFrame:
    """Frequent n-grams as ``w`` (ids), ``f`` and ``slot``; ``grams`` makes halves of ``half`` bits out of ids of ``bits`` bits."""
    spark = encoded.sparkSession
    bitmap = spark.sparkContext.broadcast(marked) if marked is not None else None

    def filters(lefts, rights):
        left, right = permuted(np.concatenate(lefts), np.concatenate(rights), half)
        left, right, counts = _summed(left, right, np.ones(len(left), np.int64))
        quotient_bits = min(half, max(1, len(left).bit_length() - 3))
        limits = [-(-(s << half) // shards) for s in range(1, shards)]  # the first value of each shard
        cuts = [0, *np.searchsorted(left, np.array(limits, np.uint64)).tolist(), len(left)]
        rows = [(s, packed(left[a:z], right[a:z], counts[a:z], half, quotient_bits)) for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["shard", "filter"])

    def count(batches):
        lefts, rights, held = [], [], 0
        for batch in batches:
            for data in batch.column("ids").to_pylist():
                ids = np.frombuffer(data, "<u4").astype(np.uint64)
                for start in range(0, len(ids), chunk):  # chunks overlap by what a phrase may still need
                    left, right = _starting(grams, ids, start, chunk, bits, bitmap.value if bitmap else None)
                    if len(left):
                        lefts.append(left)
                        rights.append(right)
                        held += len(left)
                    if held >= chunk:
                        yield filters(lefts, rights)
                        lefts, rights, held = [], [], 0
        if held:
            yield filters(lefts, rights)

    def merge(batches):
        shard, held, size = None, [], 0

        def total():
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        def frequent(entries):
            left, right, counts = entries
            kept = counts >= least
            left, right = restored(left[kept], right[kept], half)
            b, low = np.uint64(bits), _low(bits)
            if half == bits:
                w = np.stack([left, right], axis=1)
            else:
                w = np.stack([left >> b, left & low, right >> b, right & low], axis=1)
            rows = [[x for x in row if x] for row in w.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.int64())), pa.array(counts[kept]),
                 pa.array(_slots(w[:, 0], w[:, 1]).astype(np.int64))], ["w", "f", "slot"])

        for batch in batches:
            for s, data in zip(batch.column("shard").to_pylist(), batch.column("filter").to_pylist()):
                if s != shard and held:
                    yield frequent(total())
                    held, size = [], 0
                shard = s
                held.append(unpacked(data, half))
                size += len(held[-1][0])
                if size > 2 * chunk and len(held) > 1:
                    held = [total()]
                    size = len(held[0][0])
        if held:
            yield frequent(total())

    parts = encoded.mapInArrow(count, "shard int, filter binary")
    dealt = parts.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, "w array<long>, f long, slot long")


def _starting(grams, ids: np.ndarray, start: int, chunk: int, bits: int, marked):
    """Halves of the n-grams that start in a chunk of a text's ids, so that long texts take bounded memory."""
    last = start + chunk
    if len(ids) <= last:
        return grams(ids[start:], bits, marked)
    whole = grams(ids[start: last + LONGEST - 1], bits, marked)
    later = grams(ids[last: last + LONGEST - 1], bits, marked)  # those that start behind it, each once
    left, right, counts = _summed(*(np.concatenate(x) for x in zip(whole, later)), np.concatenate(
        [np.ones(len(whole[0]), np.int64), -np.ones(len(later[0]), np.int64)]))
    return np.repeat(left, counts), np.repeat(right, counts)


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """The marked slots of ``pairs`` as words of 64 bits; its size does not depend on the data."""
    words = pairs.groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("word")).toPandas()
    marked = np.zeros(1 << (PAIR_SLOTS - 6), np.uint64)
    marked[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64).view(np.uint64)
    return marked


# Scores

def weakest_cuts(phrases: DataFrame) -> DataFrame:
    """``w, a, l, r, score`` of all phrases of two words or more, by the cut of the lowest score."""
    cuts = phrases.where(F.size("w") > 1).select(
        "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "w", "a", "k", F.expr("slice(w, 1, k)").alias("first"), F.expr("slice(w, k + 1, size(w) - k)").alias("rest"))
    part = lambda name, f: phrases.select(F.col("w").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest").withColumn(
        "score", F.expr(f"(CAST(a AS DECIMAL(38, 0)) * {SCALE}) div (CAST(l AS DECIMAL(38, 0)) + r)").cast("long"))
    lowest = scored.groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("w", "a", "cut.l", "cut.r", "cut.score")


def standing_alone(found: DataFrame, holding: int = HOLDING) -> DataFrame:
    """Without phrases that mostly stand inside one longer phrase."""
    spans = F.expr("""flatten(transform(sequence(2, size(w) - 1), n ->
                      transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))))""")
    inside = found.where(F.size("w") > 2).select(F.explode(spans).alias("w"), F.col("a").alias("longer"))
    most = inside.groupBy("w").agg(F.max("longer").alias("longer"))
    return found.join(most, "w", "left").where(
        F.coalesce(F.col("longer") * 100 < F.col("a") * holding, F.lit(True))).drop("longer")


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """``lang`` and ``phrase`` instead of ``w``."""
    spots = found.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    said = spots.groupBy("w").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))),
                                                               lambda x: x.word), " ").alias("phrase"))
    return found.join(said, "w").drop("w")


def _best(df: DataFrame, top: int, *group: Column | str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, broadcast_words: int = BROADCAST_WORDS,
         chunk: int = CHUNK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases."""
    source = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), "text")
    counts = written(word_counts(source), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(dictionary(counts, least), "phrase-dictionary")
    size, total = words.agg(F.max("id"), F.sum("f")).first()
    size, total = size or 0, total or 0
    bits = max(2, size.bit_length())
    if bits > 32:
        raise ValueError("more than 2 ** 32 frequent words")
    shards = max(1, -(-total // shard_words))
    encoded = written(encode(source, words, size, broadcast_words), "phrase-ids")
    pairs = written(count_grams(encoded, _pairs, bits, bits, shards, least, chunk=chunk), "phrase-pairs")
    longer = count_grams(encoded, _longer, bits, 2 * bits, shards, least, _bitmap(pairs), chunk)
    singles = words.select(F.array("id").alias("w"), "f")
    phrases = written(singles.unionByName(pairs.select("w", "f")).unionByName(longer.select("w", "f")), "phrases")
    found = spelled(standing_alone(weakest_cuts(phrases)), words)
    # A language may hold most phrases: salted groups are cut to their first ones before they meet.
    salted = _best(found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), top, "lang", "salt")
    first = _best(salted.drop("rank", "salt"), top, "lang")
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
