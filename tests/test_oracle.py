"""Every registered query against its oracle, whole results, bit-exact doubles."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry_module
from acreledger.testbed import catalog
from acreledger.testbed.binding import BASE_TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in BASE_TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def table(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        rel = con.execute(ORACLES[name])
        names = [d[0] for d in rel.description]
        assert sorted(df.columns) == sorted(names)
        assert table(df.columns, got) == table(names, rel.fetchall())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_entry_module_registers_every_query():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
