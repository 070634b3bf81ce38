"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import queries as own, report_queries, run_queries, store_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize(("name", "of", "key"), [("generation_records", "part", "p_partkey"), ("fim_rewrite", "documents", "doc_id")])
def test_numbers_of_more_than_six_digits(spark, tmp_path, name, of, key):
    """Names of rows with such numbers are those of the SQL."""
    con = duckdb.connect()
    con.sql(f"copy (select * replace ({key} * 54321 as {key}) from '{DIR}/{of}.parquet' where {key} between 0 and 60) to '{tmp_path}/{of}.parquet'")
    con.sql(f"create view {of} as select * from '{tmp_path}/{of}.parquet'")
    df, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
    assert sorted(map(str, map(tuple, df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_documents_are_packed_in_one_stream(spark):
    run = lambda name: entry.queries()[name](spark, DIR).collect()
    ids = {r["pos"]: (r["ids"] or "").split() for r in run("char_encode")}
    stream = [x for k in sorted(k for k in ids if k is not None) if len(ids[k]) >= 2 for x in ids[k]]
    rows = {r["k"]: r["ids"].split() for r in run("pack_cross_document")}
    n = -(-(len(stream) - 1) // 64)
    assert rows == {k: stream[64 * k : 64 * k + 65] + ["2"] * (65 - len(stream[64 * k : 64 * k + 65])) for k in range(n)}
