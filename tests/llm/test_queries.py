"""Every text query over whole small tables, against SQL and against the contracts in plain Python."""

from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import rows_of
from sluice.llm import decontaminate, packing
from sluice.llm.oracle import ORACLE
from sluice.llm.queries import QUERIES, TOKENIZER
from sluice.llm.url_filter import RULES
from tests.llm import brute
from tests.llm.test_near_copies import survivors

WHOLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(WHOLE).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, WHOLE)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLE[name])
    assert got == rows_of([c[0] for c in result.description], result.fetchall())


def collected(spark, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, WHOLE).select(*columns).collect()]


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    assert not [pair for pair in zip(got, want) if pair[0] != pair[1]][:3]


def test_license_base(spark, docs):
    same(collected(spark, "op1_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
         brute.licenses(docs))


def test_license_labels_hold_the_base(spark):
    rows = QUERIES["op1_license_scan"](spark, WHOLE).collect()
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in rows)


def test_near_groups(spark, docs):
    same(collected(spark, "op2_simhash", "doc_id", "fingerprint", "component_id"), brute.near_groups(docs))


def test_quality_base(spark, docs):
    same(collected(spark, "op4_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                   "n_repeat_words", "base_failed"), brute.quality(docs))


def test_quality_scores_tell_labels_apart(spark, duck):
    rows = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, WHOLE).collect()}
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    held = [(rows[d].score, q) for d, q in labels.items() if d in rows and rows[d].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum((s >= 0.7) == bool(q) for s, q in held) / len(held) > 0.9
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.7) for r in rows.values())


def test_token_counts(spark, docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    same(collected(spark, "op5_token_counts", "doc_id", "n_tokens"),
         ((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in docs))


def test_lines(spark, docs):
    same(collected(spark, "op6_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256"), brute.lines(docs))


def test_benchmark_hits(spark, duck, docs):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = list(brute.benchmark_hits(docs, items))
    same(collected(spark, "op7_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
         want)
    # The same in several blocks of phrases and small shards.
    read = lambda t: spark.read.parquet(f"{WHOLE}/{t}.parquet")
    found = decontaminate.hits(read("documents"), read("benchmark"), block=4000)
    same([(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()], [w[:4] for w in want])


def test_packing(spark, docs):
    rows = QUERIES["op8_best_fit_packing"](spark, WHOLE).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows],
         brute.pieces(docs, Tokenizer.from_file(TOKENIZER)))
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= packing.LENGTH
    assert len(bins) <= 1.02 * sum(bins.values()) / packing.LENGTH + 1


def test_passages(spark, docs):
    same(collected(spark, "op9_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256"), brute.passages(docs))


def test_urls(spark, duck):
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    want = {w[0]: w for w in brute.hosts(pages, RULES)}
    rows = QUERIES["op10_url_filter"](spark, WHOLE).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.page_id, r.host, r.path, r.rule) == want[r.page_id][:4]
        assert r.verdict == (want[r.page_id][4] or r.verdict) and r.verdict in ("allow", "block")


def test_pipeline(spark, duck, docs):
    """The stages one after another, each over what the brute-force version of the one before has left."""
    source = spark.read.parquet(f"{WHOLE}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality_rules"](spark, source, WHOLE)
    sql = "SELECT doc_id FROM (" + ORACLE["op4_quality_rules"] + ") WHERE kept"
    good = {r[0] for r in duck.execute(sql).fetchall()}
    left = [(d, t) for d, t in docs if d in good]
    assert kept.columns == source.columns and {r.doc_id for r in kept.collect()} == good

    cut = stages["line_dedup"](spark, kept, WHOLE)
    assert cut.columns == source.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    want = {name: digest for name, _, _, digest in brute.lines(left)}
    assert {d: brute.sha(t) for d, t in texts.items()} == want

    single = stages["simhash_near_dedup"](spark, cut, WHOLE)
    first = set(survivors(sorted(texts.items())))
    assert sorted(r.doc_id for r in single.collect()) == sorted(first)

    clean = stages["benchmark_decontamination"](spark, single, WHOLE)
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = {w[0] for w in brute.benchmark_hits([(d, texts[d]) for d in first], items) if not w[-1]}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want)

    placed = stages["best_fit_packing"](spark, clean, WHOLE).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed],
         brute.pieces([(d, texts[d]) for d in want], Tokenizer.from_file(TOKENIZER)))
