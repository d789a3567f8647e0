"""Every query with SQL against DuckDB on the smallest tables, and the others for running at all."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CORE = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def connected(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def duck():
    return connected(SMALL)


def compare(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    compare(spark, duck, SMALL, name)


#: Queries of texts and of late or stored rows, which differ at the next larger size.
TEXTS = ("b1_csv_round_trip", "b4_strip_at_ingest", "b4_strip_nested", "c14_binary_placeholder", "c23_language", "d12_search", "e13_examples_from_runs", "f11_language_distribution", "f21_largest_payloads", "j6_late_stream")


@pytest.mark.parametrize("name", TEXTS)
def test_query_at_the_next_size(spark, name):
    compare(spark, connected(LARGER), LARGER, name)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
