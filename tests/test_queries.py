"""Every registered query against its SQL, on the tables the driver made."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows, columns, order):
    return sorted(([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in order] for r in (dict(zip(columns, row)) for row in rows)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, SF)
    want = tables.sql(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert plain(got.collect(), got.columns, order) == plain(want.fetchall(), want.columns, order)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang", "docs", "min_share", "avg_share", "junk_docs"}


def test_every_query_but_those_beyond_it_has_sql():
    own = {k for k in entry.queries() if not k.startswith(("op", "pipeline"))}
    assert own == set(SQL)


def test_the_package_reaches_the_executors_once(spark):
    from foliospark.shipping import ship

    ship(spark)
    before = spark.sparkContext._python_includes.count("foliospark.zip")
    ship(spark)
    assert before == spark.sparkContext._python_includes.count("foliospark.zip") == 1
