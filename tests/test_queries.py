"""Every registered query against its SQL counterpart."""

import duckdb
import pytest

import __spark_entry__ as entries
from zeitton.plans.oracle import SQL
from zeitton.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(entries.oracle_sql()) <= set(entries.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entries.queries()[name](spark, FOLDER)
    found = duck.sql(entries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert cells(df.collect(), df.columns) == cells(found.fetchall(), found.columns)


def test_entry(spark):
    assert entries.entry(spark).columns == ["measure", "lag", "acf", "pacf"]
