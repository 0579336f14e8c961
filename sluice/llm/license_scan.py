"""Licence scan by ordered signature rules.

A document's words are matched against a few hundred regexes; a rule is tried only where its keyword is among the words.
Detections are taken by priority, then length, then place; one whose interval lies inside a detection already taken is
suppressed. The base phrases are counted beside the rules and never suppressed. Row-local: nothing is shuffled.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows are scanned each
for itself; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ALNUM_WORDS, texts
from sluice.llm.license_rules import BASE, Rule, rules

BASE_PATTERNS = [(re.compile(f"(?<= ){re.escape(phrase)}(?= )"), label, phrase.split()[0]) for phrase, label in BASE]
BASE_WEIGHT = 0.9


def detect(line: str, present: set[str], by_keyword: dict[str, list[tuple[int, Rule]]]) -> list[tuple[int, int, Rule]]:
    """Detections that are left after suppression, as character intervals of ``line``."""
    found = []
    for keyword in present & by_keyword.keys():
        for order, rule in by_keyword[keyword]:
            found += [(-rule.priority, m.start() - m.end(), m.start(), order, m.end(), rule)
                      for m in rule.pattern.finditer(line)]
    taken: list[tuple[int, int, Rule]] = []
    starts: list[int] = []  # of what was taken, ascending, with the furthest end up to each
    ends: list[int] = []
    for _, _, start, _, end, rule in sorted(found, key=lambda d: d[:4]):
        at = bisect_left(starts, start + 1)
        if at and ends[at - 1] >= end:
            continue
        taken.append((start, end, rule))
        starts.insert(at, start)
        ends.insert(at, max(end, ends[at - 1] if at else 0))
        for i in range(at + 1, len(ends)):
            if ends[i] >= end:
                break
            ends[i] = end
    return taken


def scan_text(text: bytes, by_keyword: dict[str, list[tuple[int, Rule]]]) -> dict:
    words = text.translate(ALNUM_WORDS).split()
    present = {w.decode() for w in set(words)} if words else set()
    base, labels, miss = [], set(), 1.0
    if present & by_keyword.keys() or any(first in present for _, _, first in BASE_PATTERNS):
        line = f" {b' '.join(words).decode()} "
        for pattern, label, _ in BASE_PATTERNS:
            base += [(m.start(), label) for m in pattern.finditer(line)]
        taken = detect(line, present, by_keyword)
        labels = {rule.label for _, _, rule in taken}
        for _, _, rule in taken:
            miss *= 1 - rule.weight
        for _ in base:
            miss *= 1 - BASE_WEIGHT
    base_labels = {label for _, label in base}
    place = lambda at: line.count(" ", 0, at) - 1
    return {
        "n_words": len(words), "n_base": len(base),
        "first_word": place(min(base)[0]) if base else None, "last_word": place(max(base)[0]) if base else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels | base_labels)),
        "score": 1.0 - miss,
    }


RESULT = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """``doc_id`` and what was found in its text."""
    own = rules() if signatures is None else signatures

    def run(batches):
        by_keyword: dict[str, list[tuple[int, Rule]]] = {}
        for order, rule in enumerate(own):
            by_keyword.setdefault(rule.keyword, []).append((order, rule))
        for batch in batches:
            rows = [scan_text(t, by_keyword) for t in texts(batch, text)]
            result = pa.RecordBatch.from_pylist(rows, RESULT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *result.columns], ["doc_id", *RESULT.names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double")
