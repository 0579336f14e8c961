"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit for each rule that failed.
Policies are versioned sets of rules: applying one, or asking what a rule adds to it, is bit arithmetic on the ledger
and reads no text. Everything is row-local and made of Spark SQL functions.

Defined results: a null text has no words; an empty text has one empty line; repeated rows are judged alike; other
columns pass through ``ledger`` untouched unless they bear the name of a measurement, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BLANKS, blank_words, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Name and failing condition of each rule, over the measurements; the position is the bit.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("repeated_lines", "n_dup_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    ("no_letters", "10 * n_letters < 4 * word_chars"),
]

BASE = ("too_few_words", "repeated_words")

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "long_words", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _covered(starts: Column) -> Column:
    """Words under windows that begin at these ascending places."""
    following = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
    steps = F.zip_with(starts, following, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeated_starts(words: Column, n: Column) -> Column:
    """Where windows begin whose words occur at two places or more: neighbours in the sorted windows are compared."""
    windows = F.array_sort(F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    found = let(windows, lambda s: F.transform(s, lambda x, j: F.when(
        F.coalesce(x["w"] == F.get(s, j - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, j + 1)["w"], F.lit(False)),
        x["i"])))
    return F.array_sort(F.array_compact(found))


def repeat_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in the document.

    Windows are hashed first; where all hashes differ no window repeats. Else the words themselves decide.
    """
    def counted(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(n <= WINDOW, F.lit(0)).when(
            F.size(F.array_distinct(hashes)) == n - WINDOW + 1, F.lit(0)).otherwise(
            let(_repeated_starts(w, n), _covered))
    return let(words, counted)


def measurements(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = blank_words(text)
    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    word_chars = F.char_length(F.translate(text, BLANKS, ""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars.cast("long"),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_letters": F.char_length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        "n_lines": F.size(filled).cast("long"),
        "n_dup_lines": let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``, a long with one bit per rule of ``RULES``."""
    measured = docs.withColumns(measurements(F.col(text)))
    bits = [F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
            for bit, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def kept(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy lets pass, with their own columns."""
    return ledger(docs).where(passes(policy)).select(*docs.columns)


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, and those only it keeps out. One row per failure mask is shuffled."""
    rules = POLICIES[policy]
    masks = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long")).alias("failed")).agg(
        F.count("*").alias("n"))
    each = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(mask((rule,))).cast("long").alias("bit")) for rule in rules]))
    by_rule = masks.select("failed", "n", each.alias("r")).select("failed", "n", "r.rule", "r.bit")
    return by_rule.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
