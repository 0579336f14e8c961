"""Combining rows on the map side before they enter a stateful processor.

A stateful processor sees all rows of a key in one task. These steps fold the rows of a task into one row per key (and
piece of time) first, so a hot key sends a few rows per task instead of all its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows held back for further combining before a task hands them on.
HELD_ROWS = 200_000
HELD_INSTANTS = 1_000_000


# Pages of state in a bucket of keys.
PAGES = 16


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """The key as ``key`` without nulls, and ``has_key``: pandas has no nulls among numbers."""
    kind = rows.schema[key].dataType
    named = rows.withColumnRenamed(key, "key")
    return named.withColumns({"has_key": F.col("key").isNotNull(), "key": F.coalesce("key", F.lit("0").cast(kind))})


def bucket_and_page(rows: DataFrame, buckets_per_partition: int) -> DataFrame:
    """Adds the state key that a ``key`` shares with others, and its page of state there."""
    buckets = buckets_per_partition * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumns({
        "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"),
        "page": F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(PAGES)).cast("int")})


def as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _folded(combine: Callable[[pa.Table], pa.Table]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            part = combine(pa.Table.from_batches([batch]))
            held.append(part)
            rows += part.num_rows
            if rows > HELD_ROWS:
                merged = combine(pa.concat_tables(held))
                if merged.num_rows > HELD_ROWS // 2:
                    yield from merged.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = [merged], merged.num_rows
        if held:
            yield from combine(pa.concat_tables(held)).to_batches()

    return fold


def combine_counts(rows: DataFrame, key: str) -> DataFrame:
    """``key, num``: rows per key and task."""
    schema = T.StructType([rows.schema[key], T.StructField("num", T.LongType())])

    def combine(table: pa.Table) -> pa.Table:
        counted = table.group_by(key, use_threads=False).aggregate([("num", "sum")])
        return counted.rename_columns({"num_sum": "num"}).select([key, "num"])

    ones = rows.select(key, F.lit(1).cast("bigint").alias("num"))
    return ones.mapInArrow(_folded(combine), schema)


def combine_copies(rows: DataFrame) -> DataFrame:
    """Equal rows of a task as one, with their number in ``copies``."""
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("copies", T.LongType())])

    def combine(table: pa.Table) -> pa.Table:
        counted = table.group_by(columns, use_threads=False).aggregate([("copies", "sum")])
        return counted.rename_columns({"copies_sum": "copies"}).select([*columns, "copies"])

    return rows.withColumn("copies", F.lit(1).cast("bigint")).mapInArrow(_folded(combine), schema)


def combine_pieces(rows: DataFrame, key: str, time: str, width_micros: int) -> DataFrame:
    """``key, first, last, num, steps``: rows per key, task and fixed-width piece of time.

    ``first`` and ``last`` are epoch microseconds; ``steps`` holds what lies between one row and the next, from
    ``first`` on, in as few bytes as the largest step needs: ``instants`` unpacks it.
    """
    schema = T.StructType([
        rows.schema[key], *[T.StructField(c, T.LongType()) for c in ("first", "last", "num")],
        T.StructField("steps", T.BinaryType()),
    ])
    names = schema.names

    def combined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table[key].combine_chunks()
        codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        at = table["at"].to_numpy()
        piece = at // width_micros  # rounds down, also before 1970
        order = np.lexsort((at, piece, codes))
        codes, at, piece = codes[order], at[order], piece[order]
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (piece[1:] != piece[:-1])]))
        ends = np.append(starts[1:], len(at))
        steps = [_packed(at[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(order[starts])), pa.array(at[starts]), pa.array(at[ends - 1]), pa.array(ends - starts),
             pa.array(steps, pa.binary())], names)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > HELD_INSTANTS:
                yield combined(held)
                held, size = [], 0
        if held:
            yield combined(held)

    singles = rows.where(F.col(time).isNotNull()).select(key, F.unix_micros(time).alias("at"))
    return singles.mapInArrow(combine, schema)


def _packed(at: np.ndarray) -> bytes:
    steps = np.diff(at, prepend=at[0])
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(steps.max()) < 1 << 8 * w)
    return steps.astype(f"<u{width}").tobytes()


def instants(pieces: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """The instants of pieces (``first``, ``num``, ``steps``) in order, each with its number of rows."""
    times = [first + np.cumsum(np.frombuffer(bytes(steps), f"<u{len(steps) // num}").astype(np.int64))
             for first, num, steps in pieces]
    at, counts = np.unique(np.concatenate(times), return_counts=True)
    return list(zip(at.tolist(), counts.tolist()))
