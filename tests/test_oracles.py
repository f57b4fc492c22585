"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def names():
    from tidemark.plans import catalog

    return sorted(catalog.oracle_sql())


def every():
    from tidemark.plans import catalog

    return sorted(catalog.queries())


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, connection, name):
    from tidemark.plans import catalog

    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = connection.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in places) for r in result.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(every()) - set(names())))
def test_queries_without_sql_give_rows(spark, name):
    from tidemark.plans import catalog

    assert catalog.queries()[name](spark, SF).count() > 0
