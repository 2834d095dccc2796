"""The prefix trie against one built in memory, and against SQL."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kbspark.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(convs):
    """{(conv_id, depth): the other columns} of conversations {conv_id: [(role, text), ...]}."""
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not children[k]
    out = {}
    for k, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha)
    return out


def table_of(rows):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}


def frame(spark, convs):
    rows = [(c, i, r, t, 1, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [1, 7, 10**6])
def test_random_conversations(spark, rnd, least):
    convs = {}
    for c in range(-5, 300):
        turns = [("u", rnd.choice("abé")) for _ in range(rnd.choice((1, 2, 3, 4, 12)))]
        convs[c] = [("system", "long shared start " * 3)] * rnd.choice((0, 4)) + turns
    convs |= {c: [("u", "same"), ("v", "same")] for c in range(1000, 1100)}
    got = prefix_trie.prefix_trie(frame(spark, convs), heads=10**9, least=least).collect()
    want = brute(convs)
    assert len(got) == len(want) and table_of(got) == want


def test_long_shared_start_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = prefix_trie._burst
    monkeypatch.setattr(prefix_trie, "_burst", lambda *a: rounds.append(1) or plain(*a))
    convs = {c: [("u", f"turn {i}") for i in range(60)] + [("v", str(c))] for c in range(50)}
    got = prefix_trie.prefix_trie(frame(spark, convs), heads=10**9, least=10).collect()
    assert table_of(got) == brute(convs) and len(rounds) <= 2


def test_members_that_end_at_a_node_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    convs = {c: [("u", "x")] for c in range(5, 500)}
    assert table_of(prefix_trie.prefix_trie(frame(spark, convs)).collect()) == brute(convs)


def test_query_equals_sql_and_has_turnless_conversations(spark):
    got = queries.op12_conversation_prefix_trie(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.OP12_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_rebuilt(spark, rnd):
    import zlib

    convs = {c: [("u", f"{c // 10} {i}") for i in range(rnd.randrange(1, 12))] for c in range(2, 90) if c % 7}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    got = prefix_trie.trie_of(queries._rebuilt(prefix_trie.sequences(frame(spark, convs)))).collect()
    assert not all(rebuilt.values()) and table_of(got) == brute(rebuilt)


def test_odd_rows(spark):
    rows = [(1, None, None, None, 1, "x"), (1, 0, "u", "", 1, "x"), (2, 0, "", "", 1, "x"), (2, 0, "", "", 1, "x"), (None, 1, "u", "lost", 1, "x"), (3, 5, "u", "é" * 10_000, 1, "x"), (4, 5, "u", "é" * 10_000, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute({1: [("", ""), ("u", "")], 2: [("", ""), ("", "")], 3: [("u", "é" * 10_000)], 4: [("u", "é" * 10_000)]})
    assert table_of(prefix_trie.prefix_trie(df).collect()) == want
    assert prefix_trie.prefix_trie(df.where(F.lit(False))).count() == 0
