"""Every query against its SQL on the same tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def table(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, duck, name):
    made = QUERIES[name](spark, folder)
    got = table([tuple(r) for r in made.collect()], made.columns)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    assert got == table(cursor.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
