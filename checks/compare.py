"""Runs catalog queries beside their SQL twins and reports the differences: ``python -m checks.compare FOLDER [name ...]``."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from sluice.plans.catalog import CATALOG as BATCH
from sluice.streaming.catalog import CATALOG as STREAMS

CATALOG = {**BATCH, **STREAMS}
from sluice.session import build_session


def normal(value):
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(row[i]) for i in order) for row in rows)


def main(folder: str, names: list[str]) -> int:
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    failed = 0
    for name in names or list(CATALOG):
        start = time.time()
        try:
            df = CATALOG[name](spark, folder)
            got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}")
            continue
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows  {name}: {len(got)} rows, {took:.1f} s")
            continue
        try:
            result = duck.execute(ORACLE[name])
            want_columns, want = rows_of([c[0] for c in result.description], result.fetchall())
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name} (SQL): {str(error)[:800]}")
            continue
        same = got_columns == want_columns and got == want
        failed += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got)} rows, {took:.1f} s")
        if not same:
            print("   ", got_columns, want_columns, len(want))
            print("    only Spark:", sorted(set(got) - set(want))[:3])
            print("    only SQL:  ", sorted(set(want) - set(got))[:3])
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
