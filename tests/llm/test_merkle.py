"""The manifest against the contract in plain Python, over runs that are full, cut short or single."""

import pytest

from sluice.llm import merkle
from tests.llm import brute
from tests.llm.test_edges import DOCUMENTS, _same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, lang, s, n) for d, s, lang, n, t in rows], SCHEMA).repartition(parts)
    _same(rows_of(merkle.verified(df)), brute.merkle(rows))


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [257, 1, 16, 3], [1] * 18])
def test_trees_of_any_height(spark, sizes):
    rows = [(i, f"s{s:02}", "en", i, f"Text {s} {i}") for s, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


def test_nulls_ties_repeats_and_bytes(spark):
    rows = [(None, None, None, None, None)] * 3 + [(None, "é", "xx", 1, "A"), (1, None, "en", None, "Üb er"), (1, None, "en", 2, "zz")]
    rows += [(7, "s", "en", 3, "same")] * 40 + [(i, "", "", i, None) for i in range(20)] + [(-5, "~", "en", 0, ""), (5, "中", "de", 1, "ABC" * 9)]
    check(spark, rows)


def test_other_columns_and_empty_tables(spark):
    rows = [(1, "A b", "en", "s", 3, 1, "k", "f", 9, None, None, None, None, None)]
    found = merkle.verified(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert len(found) == 1 and found[0].leaf == found[0].subroot == found[0].root == found[0].folded_root
    assert merkle.verified(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_manifest_proves_what_was_not_altered(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", "ab"[i % 2], 2) for i in range(100)], SCHEMA)
    made = merkle.manifest(df)
    assert {r.n for r in made["subroots"].collect()} == {50}
    assert all(r.altered is None and len(r.path) == 3 for r in made["leaves"].collect())
    seen = merkle.verified(df).groupBy("verified").count().collect()
    assert {r["verified"]: r["count"] for r in seen}[False] == sum(brute.zlib.crc32(str(i).encode()) % 5 == 0 for i in range(100))
