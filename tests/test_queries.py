"""Every query of the core against DuckDB on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from scriptorium.plans import catalogue


def _plain(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (int, float)):
        return round(float(x), 5) + 0.0
    return str(x)


def _table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([_plain(r[i]) for i in order] for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for f in glob.glob(f"{smallest}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, smallest, name):
    df = catalogue.QUERIES[name](spark, smallest)
    got = _table([tuple(r) for r in df.collect()], df.columns)
    c = duck.execute(catalogue.ORACLES[name])
    assert got == _table(c.fetchall(), [x[0] for x in c.description])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, smallest, name):
    assert catalogue.QUERIES[name](spark, smallest).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
