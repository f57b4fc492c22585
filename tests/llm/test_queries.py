"""Registered queries over whole small tables, against SQL where there is some."""

from pathlib import Path

import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = queries.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    result = con.sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    assert got == sorted(tuple(str(r[k]) for k in places) for r in result.fetchall())


@pytest.mark.parametrize("name", [n for n in sorted(queries.queries()) if n not in ("op2_chat", "op11_search", "op13_whitening")])
def test_one_row_for_each_input_row(spark, name):
    table = {"op6_warc": "pages"}.get(name, "documents")
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
