"""Every registered query against its SQL statement, on the smallest shared tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "/root/testdata/sf0.001"
pytestmark = [
    pytest.mark.skipif(not os.path.isdir(TABLES), reason="shared tables are not here"),
    pytest.mark.usefixtures("one_ranking_input"),
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(TABLES):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return connection


def comparable(table):
    table = table.select(sorted(table.column_names))
    kinds = [str(kind).removeprefix("large_") for kind in table.schema.types]
    rows = sorted(zip(*[c.to_pylist() for c in table.columns], strict=True), key=repr)
    return table.column_names, kinds, rows


def test_every_statement_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_statement(spark, duck, name):
    found = comparable(driver.queries()[name](spark, TABLES).toArrow())
    expected = comparable(duck.sql(driver.oracle_sql()[name]).to_arrow_table())
    assert found == expected


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
