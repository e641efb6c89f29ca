"""Every registered query against its SQL in DuckDB, values and types."""

import duckdb
import pytest

import __spark_entry__ as entry
from receiptlake.plans.oracle import oracle_sql
from receiptlake.plans.queries import queries

TABLES = "orders lineitem part customer nation".split()
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "DECIMAL(18,2)": "decimal(18,2)",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_names():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})")
    assert [df.schema[c].dataType.simpleString() for c in columns] == [
        TYPES[str(t)] for t in expected.types
    ]
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got and got == sorted(map(repr, expected.fetchall()))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "product_name" in df.columns
