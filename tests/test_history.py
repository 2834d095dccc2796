"""Ancestors and topological order of commit graphs."""

import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import history

SCHEMA = "hash string, parent_hashes array<string>, timestamp long"


def frame(spark, graph):
    rnd = random.Random(1)
    return spark.createDataFrame([(h, p, rnd.randrange(5)) for h, p in graph.items()], SCHEMA).repartition(3)


def brute_layers(graph):
    out = {}
    for h, parents in graph.items():  # parents come first in these graphs
        out[h] = 1 + max((out[p] for p in parents if p in graph), default=0)
    return out


def brute_ancestors(graph, start):
    seen, todo = set(), [h for h in start if h in graph]
    while todo:
        h = todo.pop()
        if h not in seen:
            seen.add(h)
            todo += [p for p in graph[h] if p in graph]
    return seen


def random_graph(rnd, n):
    graph = {}
    for i in range(n):
        near = range(max(0, i - rnd.choice((1, 1, 3, 40))), i)
        graph[f"c{i}"] = [f"c{p}" for p in rnd.sample(near, min(len(near), rnd.choice((0, 1, 1, 1, 2, 3)) if i % 29 else 0))] + (["gone"] if rnd.random() < 0.02 else [])
    return graph


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 400)])
def test_random_graphs(spark, seed, n):
    rnd = random.Random(seed)
    graph = random_graph(rnd, n)
    df = frame(spark, graph)
    rows = history.topological_pos(df).collect()
    layers = brute_layers(graph)
    assert {r.hash: r.layer for r in rows} == layers
    when = {r.hash: r.timestamp for r in df.collect()}
    assert [r.hash for r in sorted(rows, key=lambda r: r.pos)] == sorted(graph, key=lambda h: (layers[h], when[h], h)) and sorted(r.pos for r in rows) == list(range(1, n + 1))
    since, tips = rnd.sample(sorted(graph), 3), rnd.sample(sorted(graph), 8)
    heads = lambda names: spark.createDataFrame([(h,) for h in [*names, "unknown"]], "hash string")
    got = {r.hash for r in history.not_reached(df, heads(since), heads(tips)).collect()}
    assert got == brute_ancestors(graph, tips) - brute_ancestors(graph, since)
    assert {r.hash for r in history.not_reached(df, heads(since)).collect()} == set(graph) - brute_ancestors(graph, since)


@pytest.fixture
def rounds(monkeypatch):
    made = []
    plain = history.stored
    monkeypatch.setattr(history, "stored", lambda df, name: made.append(name) or plain(df, name))
    return made


def test_a_long_chain_takes_few_rounds(spark, rounds):
    n = 100_000
    df = spark.range(n).select(F.col("id").cast("string").alias("hash"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parent_hashes"), F.col("id").alias("timestamp"))
    since = spark.createDataFrame([("70000",)], "hash string")
    got = history.not_reached(df, since).agg(F.count("*"), F.min(F.col("hash").cast("int"))).first()
    assert tuple(got) == (n - 70_001, 70_001) and len(rounds) < 40
    rounds.clear()
    assert history.layers(df).where("layer <> CAST(hash AS INT) + 1").count() == 0 and len(rounds) < 40


def test_a_ladder_of_merges_takes_few_rounds(spark, rounds):
    graph = {"m0": []}
    for i in range(1, 1000):  # a side branch of two commits is merged at every step
        graph |= {f"a{i}": [f"m{i - 1}"], f"b{i}": [f"a{i}"], f"m{i}": [f"m{i - 1}", f"b{i}"]}
    assert {r.hash: r.layer for r in history.layers(frame(spark, graph)).collect()} == brute_layers(graph)
    assert len(rounds) < 30


def test_odd_tables(spark):
    df = frame(spark, {"a": [], "b": ["a", "a"], "c": ["gone"]})
    df = df.unionByName(df)
    assert sorted((r.hash, r.layer, r.pos) for r in history.topological_pos(df).select("hash", "layer", "pos").collect())[0][:2] == ("a", 1)
    assert history.topological_pos(df).count() == 3 and history.topological_pos(df.limit(0)).count() == 0
    assert history.not_reached(df, df.limit(0).select("hash")).count() == 6
    one = spark.createDataFrame([("b",)], "hash string")
    assert sorted(r.hash for r in history.ancestors(df, one).collect()) == ["a", "b"] and history.ancestors(df.limit(0), one).count() == 0


def test_rounds_write_numbers_and_only_what_they_change(spark, monkeypatch):
    made = []
    plain = history.stored
    monkeypatch.setattr(history, "stored", lambda df, name: made.append((name, plain(df, name))) or made[-1][1])
    graph = {f"c{i}": [f"c{i - 1}"] if i % 64 else [] for i in range(6400)}
    assert {r.hash: r.layer for r in history.layers(frame(spark, graph)).collect()} == brute_layers(graph)
    assert not any(kind == "string" for _, df in made for _, kind in df.dtypes)
    assert sum(df.count() for name, df in made if name == "jumps") < 6.5 * len(graph)  # whole tables would be 8


def test_hashes_that_share_a_number_get_others(spark, monkeypatch):
    monkeypatch.setattr(history, "BITS", 10)
    graph = random_graph(random.Random(3), 60)
    df = frame(spark, graph)
    assert {r.hash: r.layer for r in history.layers(df).collect()} == brute_layers(graph)
    one = spark.createDataFrame([("c50",)], "hash string")
    assert {r.hash for r in history.ancestors(df, one).collect()} == brute_ancestors(graph, ["c50"])


def test_known_values_do_not_meet_in_one_task(spark, tmp_path):
    n, parts = 20_000, {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in parts}
    df = spark.range(n).select(F.col("id").cast("string").alias("hash"), F.array().cast("array<string>").alias("parent_hashes"), F.col("id").alias("timestamp"))
    sc = spark.sparkContext
    sc.setJobGroup("known values", "")
    try:
        for k, v in parts.items():
            spark.conf.set(k, v)
        assert history.not_reached(df, df.select("hash")).count() == 0
        sc._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    most = 0
    for job in tracker.getJobIdsForGroup("known values"):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 10_000)
            for i in range(tasks.size()):
                if (m := tasks.apply(i).taskMetrics()).isDefined():
                    most = max(most, m.get().shuffleReadMetrics().recordsRead())
    assert 0 < most < n / 2
