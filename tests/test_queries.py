"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from kbspark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        order = [want.columns.index(c) for c in df.columns]
        assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry_module(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_commits_since_gets_the_whole_manifest(spark, monkeypatch):
    got = []
    plain = queries.commits.commits_since
    monkeypatch.setattr(queries.commits, "commits_since", lambda m, sha: got.append(m) or plain(m, sha))
    queries.QUERIES["commits_since"](spark, SF)
    assert got[0].where("processed_at < 300").count() > 0
