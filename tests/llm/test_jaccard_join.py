"""The shingle join against all pairs, over similarities around the threshold and crowded lists."""

import random

import numpy as np
import pytest

from sluice.llm import jaccard_join
from sluice.llm.jaccard_join import Bands, Index
from tests.llm import brute
from tests.llm.test_edges import _same, corpus


def check(spark, docs, parts=5, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = sorted((tuple(r) for r in jaccard_join.near_groups(df, **options).collect()), key=repr)
    _same(got, brute.jaccard_groups(docs))


def near_copies(seed, bases=12, copies=9):
    draw, docs = random.Random(seed), []
    for b in range(bases):
        base = [f"w{draw.randrange(10_000)}" for _ in range(draw.choice([8, 11, 12, 20, 21, 40, 90, 300, 700]))]
        for c in range(copies):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 40))):
                kind, at = draw.randrange(3), draw.randrange(len(copy))
                copy[at: at + (kind != 1)] = [] if kind == 0 else [f"n{draw.randrange(10 ** 6)}"]
            docs.append((1000 * b + c, " ".join(copy)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_links_around_the_threshold(spark, seed):
    check(spark, near_copies(seed))


def test_edges_and_small_tiles(spark):
    docs, _ = corpus()
    docs = docs + near_copies(3, 4, 6) + [(None, "one"), (500, "One two"), (501, "two one"), (502, "one  TWO")]
    check(spark, docs)
    check(spark, docs, tile=50)


def test_large_group_with_others_in_its_lists(spark):
    """Near copies of a passage that all share segments, of which some are too far from the least node."""
    draw = random.Random(4)
    passage, docs = [f"p{i}" for i in range(120)], []
    for i in range(150):
        copy = list(passage)
        for at in draw.sample(range(120), draw.choice([0, 1, 2, 3, 4, 6])):
            copy[at] = f"x{draw.randrange(10 ** 6)}"
        docs.append((i, " ".join(copy)))
    check(spark, docs)
    check(spark, docs, tile=600)


def test_linked_pairs_agree_on_a_kept_segment():
    draw, bands = np.random.default_rng(5), Bands()
    for n in [9, 10, 11, 12, 13, 18, 19, 20, 28, 29, 43, 100, 101, 500, 3000]:
        for _ in range(20):
            held = np.unique(draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            gone = int(draw.integers(0, n // 10 + 1))
            most = max(g for g in range(n) if 10 * (n - gone) >= 9 * (n + g)) if 10 * (n - gone) >= 9 * n else None
            if most is not None:
                other = np.unique(np.concatenate([held[draw.permutation(n)[gone:]], draw.integers(0, 1 << 63, most, np.uint64)]))
                assert np.intersect1d(bands.keys(held), bands.keys(other)).size or np.array_equal(held, other), (n, gone, most)


def test_search_finds_what_a_scan_finds():
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 60, 200, np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(200) < 0.97], draw.integers(0, 1 << 60, int(draw.integers(0, 8)), np.uint64)]))
            for _ in range(80)]
    index = Index(sets)
    for query in sets:
        near = [i for i, s in enumerate(sets) if 10 * np.intersect1d(s, query).size >= 9 * np.union1d(s, query).size]
        assert index.reaching(query, np.ones(80, bool)).tolist() == near


def test_empty(spark):
    assert jaccard_join.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
