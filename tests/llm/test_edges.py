"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, over all text queries."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import decontaminate, line_dedup, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts
from sluice.llm.license_rules import Rule, rules
from sluice.llm.license_scan import detect, scan_text
from sluice.llm.queries import QUERIES, TOKENIZER
from sluice.llm.url_filter import RULES
from tests.llm import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, k1 string, fp string, root int, " \
    "failed string, n_lines string, _k1 string, shard string, at string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeéß中") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, long = prose(60), prose(30_000)
    docs = [(None, None), (None, ""), (1, None), (2, ""), (3, " \t\n"), (4, "\n\n"), (5, "one"), (6, "A b C d"),
            (7, long), (8, long), (9, long + " end"), (None, passage), (None, prose(80)),
            (10, "The MIT  License, the GNU General Public\nLicense; MIT License."), (11, "caf\u00e9 \u00a0 <|endoftext|> İ ΑΣ. don't"),
            (12, "\x00a\x1fb\x0bc"), (13, "||||| %%% $$$ " * 20), (14, "x\r\ny\r\nX \r\n")]
    docs += [(20 + i, f"{prose(12)}\nCommon Line {'!' * (i % 2)}\n  common line \n{passage} {prose(3)}") for i in range(14)]
    docs += [(60, prose(50))] * 3 + [(61, "same id"), (61, "another text of one id")]
    near = prose(300).split()
    for i in range(12):
        copy = list(near)
        copy[20 * i] = "changed"
        docs.append((70 + i, " ".join(copy)))
    return docs, passage


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder, (docs, passage) = str(tmp_path_factory.mktemp("edges")), corpus()
    items = [(1, passage), (2, "one"), (3, ""), (4, None), (None, "café endoftext"), (5, passage), (6, "words that never occur at all")]
    urls = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://"), (5, "https://A.Example.NET/en/x?q#f"), (5, "x://net/"),
            (6, "http://b.net?x=/"), (7, "http://example.com/de/1://org/fr/"), (8, "http://user@x.org:80/fr/"), (None, "http://notnet/"),
            (9, "http://org/fr"), (9, "http://org/fr/")]
    rows = [(d, t, None, "s", None, 7, "k", None, 1, "f", "l", "u", "h", "a") for d, t in docs]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, d % 2, None, "clash") for d in range(1, 30)] + [(1, None, 1, None), (None, 1, 1, None)] * 2,
                          LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(p, u, None, "x", True) for p, u in urls],
                          "page_id long, url string, html string, host string, verdict boolean").write.parquet(f"{folder}/pages.parquet")
    return folder, docs, items, urls


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {"documents": DOCUMENTS, "labels": LABELS, "benchmark": "item_id long, text string",
                         "pages": "page_id long, url string, html string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def got(spark, folder, name, *columns):
    df = QUERIES[name](spark, folder)
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_every_query_on_edges(spark, made):
    folder, docs, _, urls = made
    tokenizer = Tokenizer.from_file(TOKENIZER)
    same = lambda name, want, *columns: _same(got(spark, folder, name, *columns), want)
    same("op1_license_scan", brute.licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same("op2_simhash", brute.near_groups(docs))
    same("op4_quality_rules", brute.quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
         "n_repeat_words", "base_failed")
    same("op6_line_dedup", brute.lines(docs))
    same("op8_best_fit_packing", brute.pieces(docs, tokenizer), "doc_id", "piece", "start", "length", "ids_crc32")
    same("op9_substring_dedup", brute.passages(docs))
    same("op10_url_filter", (w[:4] for w in brute.hosts(urls, RULES)), "page_id", "host", "path", "rule")
    same("op11_jaccard_join", brute.jaccard_groups(docs))
    same("op12_merkle_manifest", brute.merkle([(d, "s", None, None, t) for d, t in docs]))
    assert got(spark, folder, "op13_phrase_collocations") == sorted(brute.phrases([(None, t) for _, t in docs]), key=repr)
    tokenizer.encode_special_tokens = True
    same("op5_token_counts", ((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in docs),
         "doc_id", "n_tokens")
    scores = got(spark, folder, "op3_quality_classifier")
    assert len(scores) == len(docs) and all(0 <= s[2] <= 1 for s in scores)


def _same(rows, want):
    want = sorted((tuple(w) for w in want), key=repr)
    assert len(rows) == len(want)
    assert not [pair for pair in zip(rows, want) if pair[0] != pair[1]][:3]


def test_benchmark_on_edges(spark, made):
    folder, docs, items, _ = made
    want = brute.benchmark_hits(docs, [(i, t) for i, t in items if i is not None])
    read = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id IS NOT NULL")
    found = decontaminate.hits(spark.read.parquet(f"{folder}/documents.parquet"), read)
    _same(sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()), key=repr), (w[:4] for w in want))
    assert len(got(spark, folder, "op7_decontamination")) == len(docs)


def test_empty_tables(spark, empty):
    for name in QUERIES:
        assert got(spark, empty, name) == [], name
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_pipeline_on_edges(spark, made):
    folder, docs, _, _ = made
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, folder)
        assert after.schema.names == held.schema.names
        rows = after.collect()
        assert rows and all(r.k1 == "k" and r.n_words == 7 and r.failed == "f" for r in rows), name
        held = spark.createDataFrame(rows, held.schema)
    assert len({r.text for r in rows}) == len(rows)
    assert not [r for r in rows if 20 <= (r.doc_id or 0) < 34]  # the benchmark passage
    assert len(corpus_pipeline.run(spark, folder).collect()) >= len(rows)


def test_rules_suppress_what_lies_inside():
    by_keyword = {}
    for order, rule in enumerate(rules()):
        by_keyword.setdefault(rule.keyword, []).append((order, rule))
    labels = lambda text: {r.label for _, _, r in detect(f" {text} ", set(text.split()), by_keyword)}
    assert labels("under the gnu lesser general public license v3") == {"lgpl"}
    assert labels("cc by nc sa 4 0") == {"cc-by-nc-sa"}
    assert "cc-by" not in labels("licensed under cc by nc 4 0")
    assert labels("spdx license identifier mit license") == labels("spdx license identifier mit") == {"mit"}
    assert len(rules()) > 300 and all(isinstance(r, Rule) for r in rules())


def test_ledger_policies_and_ablation(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "$ % & " * 30), (3, "plain words of a clean text " + "more than ten of them here")],
                                 "doc_id long, text string")
    entries = quality_rules.ledger(docs)
    assert {r.doc_id for r in entries.where(quality_rules.passes("base")).collect()} == {3}
    found = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(entries, "v1").collect()}
    assert found["too_few_words"] == (1, 1) and found["repeated_words"] == (1, 0) and found["symbols"] == (1, 0)


def test_runs_are_compacted_and_leave_out_the_known(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2, buckets=2)
    batch = lambda *rows: spark.createDataFrame(rows, "h1 long, h2 long, docs long")
    runs.add(batch((1, 1, 2), (2, 2, 1)))
    runs.add(batch((1, 1, 1), (3, 3, 5)))
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.add(batch((1, 1, 9), (2, 2, 1)))
    assert {r.h1 for r in spark.table(runs.levels[0][0]).collect()} == {2}
    runs.add(batch((2, 2, 1)))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {r.h1 for r in runs.frequent().collect()} == {1, 2, 3}


def test_hot_cells_and_crowded_anchors_give_the_same(spark, made):
    folder, docs, _, _ = made
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    points = simhash.fingerprints(source).select("fp").distinct()
    from sluice.llm.components import components
    few, tiled = (sorted(tuple(r) for r in components(simhash.links(points, cell_rows=n)).collect()) for n in (4096, 2))
    assert few == tiled and few
    plain, crowded = (sorted((tuple(r) for r in substring_dedup.dedup(source, **s).collect()), key=repr)
                      for s in ({}, {"crowded": 1}))
    assert plain == crowded


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green blue"), (2, "red green blue"), (3, "blue green red")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    exact, near = ({r.doc_id for r in decontaminate.hits(docs, bench, slop=s).where("n_hit > 0").collect()} for s in (0, 1))
    assert exact == {2} and near == {1, 2}


def test_equal_rows_in_many_shards_and_phrases_in_blocks(spark):
    docs = spark.createDataFrame([(1, "red green blue")] * 40 + [(2, "blue")], "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(i, f"red green {w}") for i, w in enumerate(["blue", "gray", "pink"])] + [(9, "blue")],
                                  "item_id long, text string")
    want = sorted([(1, 3, 3, ["0", "9"])] * 40 + [(2, 1, 1, ["9"])])
    for block in (1, 4, decontaminate.TERMS):
        found = decontaminate.hits(docs, bench, block=block).select("doc_id", "n_words", "n_hit", "items")
        assert sorted(tuple(r) for r in found.collect()) == want, block


def test_blocks_are_stitched(spark, tmp_path):
    import numpy as np
    draw = np.random.default_rng(3)
    for name, tail in (("a", False), ("b", True), ("c", False)):
        ids = draw.integers(1, 9, 500).astype("<u2")
        ids[draw.random(500) < 0.05] = 0
        ids[-1] = 5 if tail else 0
        (ids[:0] if name == "c" else ids).tofile(tmp_path / f"{name}.bin")
    for block in (7, 100, 1000):
        rows = token_counts.count_tokens(spark, str(tmp_path), separator=0, block_tokens=block).collect()
        for name in "abc":
            ids = np.fromfile(tmp_path / f"{name}.bin", "<u2")
            parts = np.split(ids, np.flatnonzero(ids == 0) + 1)
            want = [(len(p) - 1, True) if len(p) and p[-1] == 0 else (len(p), False) for p in parts if len(p)]
            mine = sorted((r for r in rows if r.file == f"{name}.bin"), key=lambda r: r.ordinal)
            assert [(r.n_tokens, r.terminated) for r in mine] == want and [r.ordinal for r in mine] == list(range(len(want)))


def test_every_capacity_holds():
    import numpy as np
    lengths = np.sort(np.random.default_rng(1).integers(1, 54, 300))[::-1]
    for by in ("norm", "dot"):
        bins, offsets = packing.best_fit(lengths, (100, 4, 3000), (1.0, 0.5, 0.5), by)
        for b in set(bins.tolist()):
            own = lengths[bins == b]
            assert own.sum() <= 100 and len(own) <= 4 and (own ** 2).sum() <= 3000 or len(own) == 1
            assert sorted(zip(offsets[bins == b], own))[0][0] == 0


def test_pooled_is_monotone():
    import numpy as np
    x, y = quality_classifier.pooled(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 0, 1.0]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    assert quality_classifier.statistics(b"") == [0.0] * len(quality_classifier.STATISTICS)


def test_every_keyword_stands_in_each_match_of_its_rule():
    """Random matches of every pattern: one of the keywords under which it is registered is among their words."""
    from re import _parser

    draw, keywords = random.Random(3), {}
    for rule in rules():
        keywords.setdefault((rule.label, rule.pattern.pattern), set()).add(rule.keyword)

    def made(parsed):
        out = ""
        for kind, value in parsed:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "NOT_LITERAL":
                out += draw.choice("xyz")
            elif name == "IN":
                picked = draw.choice(value)
                out += "x" if str(picked[0]) == "NEGATE" else chr(picked[1] if str(picked[0]) == "LITERAL" else draw.randint(*picked[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, below = value
                out += "".join(made(below) for _ in range(draw.randint(low, min(high, low + 2))))
            elif name == "SUBPATTERN":
                out += made(value[-1])
            elif name == "BRANCH":
                out += made(draw.choice(value[1]))
        return out

    for (label, pattern), words in keywords.items():
        for _ in range(40):
            text = made(_parser.parse(pattern))
            assert words & set(text.split()), (label, pattern, text)


def test_spdx_tags_and_long_holders():
    by_keyword = {}
    for order, rule in enumerate(rules()):
        by_keyword.setdefault(rule.keyword, []).append((order, rule))
    said = lambda text: scan_text(text.encode(), by_keyword)["labels"]
    for tag, label in {"MIT": "mit", "ISC": "isc", "Zlib": "zlib", "EPL-2.0": "epl", "BSL-1.0": "boost", "Artistic-2.0": "artistic",
                       "GPL-2.0-or-later": "gpl", "LGPL-2.1-only": "lgpl", "Apache-2.0": "apache", "CC-BY-NC-SA-4.0": "cc-by-nc-sa",
                       "BSD-3-Clause": "bsd-3-clause", "0BSD": "bsd-0-clause"}.items():
        assert said(f"// SPDX-License-Identifier: {tag}\n") == label, tag
    assert said("the Common Public License 1.0") == "cpl" and said("under FreeBSD license") == "bsd-2-clause"
    assert said("lgplv3 or later") == "lgpl"
    assert said("Permission is hereby granted, free of charge, to any person obtaining a copy") == "mit"
    holder = "the Regents of the University of a State with a very long name, its laboratories and all of its other contributors,"
    assert said(f"Neither the name of {holder} may be used to endorse or promote products") == "bsd-3-clause"


def test_many_empty_texts_and_a_phrase_of_all_items(spark):
    nulls = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    some = spark.createDataFrame([(1, "a common head of the prompt w1 and on"), (2, "common head of"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"common head of the prompt w{i}") for i in range(2000)], "item_id long, text string")
    found = decontaminate.hits(nulls.unionByName(some).coalesce(1), bench, window=5)
    assert found.count() == 300_003 and found.where("n_hit = 0").count() == 300_002
    row = found.where("n_hit > 0").first()
    assert (row.doc_id, row.n_hit, len(row["items"])) == (1, 6, 2000)


def test_equal_rows_are_packed_in_all_shards(spark):
    rows = [(None, "one two three")] * 600 + [(i, "four five " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = packing.pieces(df, TOKENIZER).withColumn("row", F.monotonically_increasing_id())
    from sluice.llm.common import written
    placed = packing.pack(written(cut, "pieces"), shard_pieces=100)
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    shards = placed.withColumn("shard", F.shiftright("sequence_id", 32)).groupBy("shard").count().collect()
    assert len(shards) == 9 and max(r["count"] for r in shards) < 200 and sum(r["count"] for r in shards) == len(rows)


def test_repeated_rows_keep_their_stretches_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, passage)] * 50 + [(2, f"x y {passage} z"), (3, "a b c")]
    got = substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 60, 60)] * 50 + [(2, 63, 60), (3, 3, 0)]


def test_rests_of_all_shards_are_packed_together(spark):
    """Sixty shards of a few pieces each: alone they leave a poor bin each, together hardly any."""
    rows = [(i, 0, 0, 1 + (i * 7919) % 900, 0, i) for i in range(1200)]
    names = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
    cut = spark.createDataFrame(rows, names)
    least = sum(r[3] for r in rows) / packing.LENGTH

    def bins(**settings):
        held = {}
        for r in sorted(packing.pack(cut, shard_pieces=20, **settings).collect(), key=lambda r: (r.sequence_id, r.offset)):
            assert held.get(r.sequence_id, 0) == r.offset
            held[r.sequence_id] = r.offset + r.length
        assert max(held.values()) <= packing.LENGTH and sum(held.values()) == sum(r[3] for r in rows)
        return len(held)

    alone, together = bins(full=0.0), bins()
    assert alone > 1.05 * least and together - least < (alone - least) / 2


def test_a_hot_anchor_is_shared_by_many_texts(spark):
    """A third of all texts hold one passage, each in different surroundings."""
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for d in range(90):
        own = [f"d{d}w{i}" for i in range(50)]
        docs.append((d, " ".join(own[:25] + (passage if d % 3 == 0 else []) + own[25:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for crowded in (2, 2_000):
        got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(df, crowded=crowded).collect()}
        assert got == {d: 40 if d % 3 == 0 else 0 for d in range(90)}
