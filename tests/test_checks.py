"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF_DIR}/{t}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else x

    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, twin, name):
    df = driver.queries()[name](spark, SF_DIR)
    rows = df.collect()
    assert rows
    if name in driver.oracle_sql():
        result = twin.execute(driver.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert comparable(rows, df.columns) == comparable(result.fetchall(), columns)


def test_every_twin_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
