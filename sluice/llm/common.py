"""Helpers shared by the operators: tables, row keys, text classes, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_folder

#: The white space that separates words, as a Java regex class and as characters.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"

#: Bytes to bytes: A-Z to lower case, everything in ASCII that is no letter or digit to a space.
ALNUM_WORDS = bytes(
    c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isupper() else 0x20
    for c in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once and outlives a lost executor."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> list[Column]:
    """128 bits that stand for the values of a row, as two longs ``k1`` and ``k2``; equal rows share them."""
    values = [F.col(c) for c in columns]
    marks = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(*values, *marks).alias("k1"), F.xxhash64(F.lit(1), *values, *marks).alias("k2")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does for texts that are ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase))


def blank_words(text: Column) -> Column:
    """The words between white space, as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def shielded(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all other columns under names that clash with none of an operator's, and what names them back."""
    names = {c: c if c in own else f"_other{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), lambda df: df.select(
        *[F.col(n).alias(c) for c, n in names.items()])


def texts(batch, column: str = "text") -> list[bytes]:
    """The UTF-8 of an Arrow column of texts; null reads as empty."""
    return [t or b"" for t in batch.column(column).cast("binary").to_pylist()]
