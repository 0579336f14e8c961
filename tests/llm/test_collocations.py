"""Phrases against the contract in plain Python; filters as exact counters."""

import random

import numpy as np
import pytest

from sluice.llm import collocations
from tests.llm import brute
from tests.llm.test_edges import DOCUMENTS, _same

SCHEMA = "lang string, text string"


def corpus(seed=1, docs=300):
    draw = random.Random(seed)
    words = ["the", "of", "The", "new", "york", "city", "a", "b", "café", "中", "x\x01", "x", "rare"] + [f"w{i}" for i in range(40)]
    weights = [30, 25, 10, 9, 9, 8, 5, 5, 4, 4, 3, 3, 1] + [1] * 40
    rows = []
    for i in range(docs):
        parts = draw.choices(words, weights, k=draw.randint(0, 60))
        for _ in range(draw.randint(0, 4)):
            parts.insert(draw.randint(0, len(parts)), draw.choice(["new york city", "one two three four", ". end\nof", "a\tb , a b", "\x0b"]))
        rows.append((draw.choice(["en", "de", None, "und", ""]), " ".join(parts)))
    return rows + [("en", None), (None, ""), ("en", "\n\n..")] + [("fr", "même phrase ici")] * 40


def mined(spark, rows, parts=4, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in collocations.mine(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_words": 0}, {"least": 5, "top": 7}])
def test_same_as_counting_all(spark, options):
    want = {k: v for k, v in options.items() if k != "broadcast_words"}
    _same(mined(spark, corpus(), **options), brute.phrases(corpus(), **want))


def test_chunks_and_shards_do_not_show(spark):
    rows = corpus(2, 60) + [("en", "the new york of " * 3000)]
    want = list(brute.phrases(rows))
    for chunk, shard in ((7, 100), (1000, 500)):
        ids = np.array([1, 2, 3, 0, 1, 2, 3, 1, 2, 0, 3, 3, 3, 1, 2] * 9, np.uint64)
        for grams in (collocations._pairs, collocations._longer):
            marked = np.full(1 << (collocations.PAIR_SLOTS - 6), (1 << 64) - 1, np.uint64)
            parts = [collocations._starting(grams, ids, s, chunk, 2, marked) for s in range(0, len(ids), chunk)]
            whole = grams(ids, 2, marked)
            pairs = lambda x: sorted(zip(x[0].tolist(), x[1].tolist()))
            assert pairs([np.concatenate(x) for x in zip(*parts)]) == pairs(whole)
        _same(mined(spark, rows, chunk=max(chunk, 300), shard_words=shard), want)


def test_filters_are_exact():
    draw = np.random.default_rng(3)
    for bits in (2, 9, 17, 31, 32, 40, 64):
        top = (1 << bits) - 1
        left, right = (draw.integers(0, top, 5000, np.uint64, endpoint=True) for _ in range(2))
        a, b = collocations.restored(*collocations.permuted(left, right, bits), bits)
        assert (a == left).all() and (b == right).all()
        entries = collocations._summed(*collocations.permuted(left, right, bits), draw.integers(1, 600, 5000))
        assert len(set(zip(entries[0].tolist(), entries[1].tolist()))) == len(entries[0])
        for quotient in {1, min(bits, 7), min(bits, 12)}:
            back = collocations.unpacked(collocations.packed(*entries, bits, quotient), bits)
            assert all((x == y).all() for x, y in zip(entries, back))


def test_other_columns_and_empty_tables(spark):
    rows = [(1, "a b", None, "s", 3, 1, "k", "f", 9, None, None, None, None, None)] * 30
    found = collocations.mine(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert [tuple(r) for r in found] == [("und", 1, "a b", 30, 30, 30, 60, 1_000_000)]
    assert collocations.mine(spark.createDataFrame([], DOCUMENTS)).collect() == []
