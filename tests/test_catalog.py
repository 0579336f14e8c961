from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import rows_of
from checks.oracle import ORACLE
from sluice.plans.catalog import CATALOG
from sluice.streaming.catalog import CATALOG as STREAMS


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_a_twin():
    assert {*CATALOG, *STREAMS} == set(ORACLE)
    assert {*CATALOG, *STREAMS} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["auction", "num"]
    assert df.count() > 0


@pytest.mark.parametrize("name", [*CATALOG, *STREAMS])
def test_same_as_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert got == want
