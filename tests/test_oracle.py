"""Every registered query against its SQL over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

#: Queries that fit models many times; their parts are tested by themselves.
SLOW = {"forest_metrics", "forest_ablation", "forest_null", "forest_stability", "forest_importances", "score_table"}


def norm(v):
    if v is None or v != v:
        return None
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, data)
    got = df.collect()
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as from read_parquet('{data}/{f}')")
    relation = con.sql(entry.oracle_sql()[name])
    columns = sorted(relation.columns)
    assert columns == sorted(df.columns)
    wanted = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(norm(r[c]) for c in columns) for r in got), key=str) == sorted((tuple(map(norm, r)) for r in wanted), key=str)


def test_entry(spark, data):
    assert set(entry.oracle_sql()) <= set(entry.queries())
