"""Every report against its SQL on the given tables: rows, columns and values."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from pagetally.plans.check_sql import CHECK_SQL
from pagetally.plans.reports import REPORTS
from tests.conftest import TESTDATA

SCALES = ("sf0.001", "sf0.01")


@pytest.fixture(scope="module", params=SCALES)
def folder(request):
    return f"{TESTDATA}/{request.param}"


@pytest.fixture(scope="module")
def tables(folder):
    db = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return db


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


SQL_TYPES = {
    "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_equals_sql(spark, tables, folder, name):
    result = contract.queries()[name](spark, folder)
    expected = tables.execute(contract.oracle_sql()[name])
    columns = {c[0]: str(c[1]) for c in expected.description}
    assert {n: SQL_TYPES[t] for n, t in result.dtypes} == columns
    got = rows_of(result.columns, result.collect())
    want = rows_of(list(columns), expected.fetchall())
    assert got == want
    assert got


def test_every_report_has_sql():
    assert REPORTS.keys() == CHECK_SQL.keys()
    assert contract.queries().keys() >= REPORTS.keys()
    assert contract.oracle_sql().keys() >= CHECK_SQL.keys()


def test_entry(spark):
    assert contract.entry(spark).count() == 50
