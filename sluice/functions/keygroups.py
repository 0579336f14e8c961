"""Key hashes, key groups, slots and virtual partitions as column expressions.

The key-group hash is Murmur3 over one 32-bit word with seed 0. Spark's ``hash`` is the same function with seed 42 and
chains its arguments, each one's result seeding the next. A first argument that hashes to 0 therefore turns
``hash(first, word)`` into the seed-0 hash, so the whole mapping stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MAX_PARALLELISM = 128

WORD = 0xFFFFFFFF
SIGN = 0x80000000

# Fixed value: the int whose Murmur3 hash under Spark's seed 42 is 0.
SEED_ZERO_WORD = -1693959553

KEY_TYPES = {"string": "string", "int": "int", "long": "bigint"}


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _div(dividend: Column, divisor: int) -> Column:
    return F.call_function("div", dividend, F.lit(divisor))


def _signed(word: Column) -> Column:
    """The low 32 bits of a bigint as a signed int."""
    low = word.bitwiseAND(F.lit(WORD))
    return (((low + F.lit(SIGN)) % F.lit(WORD + 1)) - F.lit(SIGN)).cast("int")


def java_hash(column, kind: str) -> Column:
    """Java's hash code of a string (by code point), an int or a long."""
    value = _col(column)
    if kind == "int":
        return value.cast("int")
    if kind == "long":
        value = value.cast("bigint")
        return _signed(F.shiftrightunsigned(value, 32).bitwiseXOR(value))
    if kind == "string":
        rolled = F.aggregate(
            F.split(value, ""),
            F.lit(0).cast("bigint"),
            lambda h, c: (h * F.lit(31) + F.ascii(c)).bitwiseAND(F.lit(WORD)),
        )
        return _signed(rolled)
    raise ValueError(f"key type {kind!r} is not one of {sorted(KEY_TYPES)}")


def composite_hash(fields) -> Column:
    """XOR of the field hashes of ``[(column, kind), ...]``; an absent (null) field adds nothing."""
    total = F.lit(0).cast("int")
    for column, kind in fields:
        total = total.bitwiseXOR(F.coalesce(java_hash(column, kind), F.lit(0).cast("int")))
    return total


def key_group(hash_code, max_parallelism: int = DEFAULT_MAX_PARALLELISM) -> Column:
    """Key group of a 32-bit hash code."""
    mixed = F.hash(F.lit(SEED_ZERO_WORD), _col(hash_code).cast("int")).cast("bigint")
    magnitude = F.when(mixed == F.lit(-SIGN), F.lit(0).cast("bigint")).otherwise(F.abs(mixed))
    return (magnitude % F.lit(max_parallelism)).cast("int")


def slot(group, parallelism: int, max_parallelism: int = DEFAULT_MAX_PARALLELISM) -> Column:
    """Index of the parallel instance that owns a key group."""
    return _div(_col(group).cast("bigint") * F.lit(parallelism), max_parallelism).cast("int")


def key_slot(fields, parallelism: int, max_parallelism: int = DEFAULT_MAX_PARALLELISM) -> Column:
    return slot(key_group(composite_hash(fields), max_parallelism), parallelism, max_parallelism)


def split_owner(topic, partition, readers: int) -> Column:
    """Index of the reader that owns a partition of a topic."""
    scaled = (java_hash(topic, "string").cast("bigint") * F.lit(31)).bitwiseAND(F.lit(SIGN - 1))
    start = scaled % F.lit(readers)
    return ((start + _col(partition)) % F.lit(readers)).cast("int")


def origin_partition(virtual, num_sources: int, num_partitions: int) -> Column:
    """Real partition behind a virtual one: source s walks the partitions from s on."""
    virtual = _col(virtual).cast("bigint")
    source = virtual % F.lit(num_sources)
    turn = _div(virtual, num_sources)
    return ((source + turn) % F.lit(num_partitions)).cast("int")


def virtual_offset(offset, split, num_sources: int) -> Column:
    return _col(offset) * F.lit(num_sources) + _col(split)


def real_offset(virtual, split, num_sources: int) -> Column:
    return _div(_col(virtual) - _col(split), num_sources)
