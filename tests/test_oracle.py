"""Every registered query against its DuckDB twin on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, data_dir, name):
    df = entry.queries()[name](spark, data_dir)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    at = [columns.index(c) for c in order]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())
    assert mine == theirs
