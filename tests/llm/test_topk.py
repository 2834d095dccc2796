"""Exact top-k against all inner products."""

import math

import duckdb
import numpy as np
import pytest

from kbspark.llm import queries, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, score string, rank int, block binary"


def brute(rows, asked, k, scale=1024):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if asked(q):
            mine = sorted((-max(-topk._LONG, min(topk._LONG, sum(a * b for a, b in zip(v, w)))), i) for i, w in whole if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(mine[:k], 1)]
    return sorted(out)


def found(spark, rows, k, lists=4):
    df = spark.createDataFrame([(i, v, "s", 1, b"b") for i, v in rows], SCHEMA).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 7 = 0"), k, lists=lists).collect()
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in got)


@pytest.mark.parametrize("k, lists, group", [(1, 4, 1 << 24), (5, 3, 1500), (40, 1, 1 << 24), (500, 4, 1 << 24)])
def test_random_vectors(spark, monkeypatch, k, lists, group):
    monkeypatch.setattr(topk, "GROUP_BYTES", group)
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    g = np.random.default_rng(3)
    centres = g.normal(size=(4, 9))
    rows = [(i, (centres[i % 4] + g.normal(size=9) * (0.1 if i % 3 else 0.0)).tolist()) for i in range(-40, 300)]
    assert found(spark, rows, k, lists) == brute(rows, lambda q: q % 7 == 0, k)


def test_negative_scores_ties_and_large_numbers(spark):
    rows = [(i, [-1.0 - i % 3, 2.0]) for i in range(40)] + [(i, [0.0, 0.0]) for i in range(40, 60)]
    rows += [(100 + i, [1e30 * (i - 5), 1.0]) for i in range(12)] + [(200 + i, [3e7 + i, 1e8]) for i in range(9)]
    for k in (3, 200):
        assert found(spark, rows, k) == brute(rows, lambda q: q % 7 == 0, k)


def test_cutoff_lets_few_rows_through(spark):
    """The second phase passes on what reaches the cutoff, not the k best of every part."""
    g = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(g.normal(size=(2000, 16)).tolist())], "vec_id long, embedding array<double>").repartition(8)
    asked, rows = topk.packed(df.where("vec_id < 5"), 1024, 512, "vec_id", "embedding"), topk.packed(df, 1024, 100, "vec_id", "embedding")
    lists = topk._meet(rows, asked.selectExpr("*", "CAST(NULL AS BINARY) AS cutoff"), 1, 12, 10, 4)
    best = topk._meet(rows, topk._with_cutoffs(asked, lists, 10), 1, 12, 10, 4)
    assert 50 <= best.count() < lists.count() / 2


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (7, None), (14, [1.0, None]), (21, [float("nan"), 1.0]), (28, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0]), (35, [2.0]), (2, [3.0, -4.0]), (3, [3.0, -4.0]), (42, []), (4, []), (49, [1.0, 2.0, 3.0])]
    assert found(spark, rows, 10) == brute(rows, lambda q: q % 7 == 0, 10)
    again = found(spark, rows + [(3, [3.0, -4.0])], 10)
    assert [r[2] for r in again if r[0] == 0] == [2, 3, 3]
    assert found(spark, [], 10) == []


def test_query_equals_sql(spark):
    got = queries.op11_exact_top_k(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.OP11_SQL)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
