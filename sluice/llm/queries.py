"""The registered queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import (
    collocations, decontaminate, jaccard_join, license_scan, line_dedup, merkle, packing, quality_classifier,
    quality_rules, simhash, substring_dedup, token_counts, url_filter,
)
from sluice.llm.common import table, written
from sluice.session import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def licenses(spark, folder) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def near_duplicates(spark, folder) -> DataFrame:
    found = simhash.near_groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def quality_scores(spark, folder) -> DataFrame:
    return quality_classifier.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def rule_ledger(spark, folder) -> DataFrame:
    entries = quality_rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes(quality_rules.CURRENT).alias("kept"))


def counted_tokens(spark, folder) -> DataFrame:
    files = shared_folder(spark, "token-files")
    listed = written(token_counts.write_tokens(table(spark, folder, "documents"), files, TOKENIZER), "token-manifest")
    # The manifest is small as a file and large as rows: it is never broadcast.
    return listed.hint("merge").join(token_counts.count_tokens(spark, files), ["file", "ordinal"]).select(
        "doc_id", "n_tokens", "file", "ordinal", "token_start")


def frequent_lines(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def benchmark_hits(spark, folder) -> DataFrame:
    found = decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def packed_sequences(spark, folder) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), TOKENIZER)


def repeated_passages(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def url_verdicts(spark, folder) -> DataFrame:
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return url_filter.judge(table(spark, folder, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def shingle_groups(spark, folder) -> DataFrame:
    found = jaccard_join.near_groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def verified_rows(spark, folder) -> DataFrame:
    return merkle.verified(table(spark, folder, "documents"))


def phrases(spark, folder) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


QUERIES = {
    "op1_license_scan": licenses,
    "op2_simhash": near_duplicates,
    "op3_quality_classifier": quality_scores,
    "op4_quality_rules": rule_ledger,
    "op5_token_counts": counted_tokens,
    "op6_line_dedup": frequent_lines,
    "op7_decontamination": benchmark_hits,
    "op8_best_fit_packing": packed_sequences,
    "op9_substring_dedup": repeated_passages,
    "op10_url_filter": url_verdicts,
    "op11_jaccard_join": shingle_groups,
    "op12_merkle_manifest": verified_rows,
    "op13_phrase_collocations": phrases,
}
