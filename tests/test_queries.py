"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return
    cur = db.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["pattern_scan_docs", "scan_traffic", "web_wrap", "git_pattern", "browser_storage", "answer_postprocess"])
def test_no_secret_in_any_output(spark, name):
    import re

    from leakscope.catalog import default_catalog

    dump = "\n".join(str(r) for r in QUERIES[name](spark, SF).drop("url").collect())
    for p in default_catalog():
        assert not re.search(p.regex, dump), p.raw_name
