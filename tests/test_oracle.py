"""Every registered query with SQL against DuckDB on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry

from tests.conftest import rows_of

FOLDER = os.environ.get("LAKESMITH_TESTDATA", "/root/testdata/sf0.001")
SQL, QUERIES = entry.oracle_sql(), entry.queries()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(normal, r)) for r in cursor.fetchall()), key=str)


def test_p7_unified_holds_the_records_of_p7_state(spark):
    """Without SQL; tests/test_training.py holds its fields against brute force."""
    df, state = QUERIES["p7_unified"](spark, FOLDER), QUERIES["p7_state"](spark, FOLDER)
    assert df.dtypes == state.dtypes and rows_of(df, "event_id", "updated_us") == rows_of(state, "event_id", "updated_us")


def test_every_core_query_but_one_has_sql():
    from lakesmith.plans import registry

    assert set(registry.QUERIES) - set(registry.SQL) == {"p7_unified"}


def test_entry_is_registered(spark):
    assert set(SQL) <= set(QUERIES) and entry.entry(spark).columns == ["customer_id", "company_name", "plan", "segment", "event_count"]
