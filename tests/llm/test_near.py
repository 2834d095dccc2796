import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kbspark.llm import common, graph, ngram_join, shingles
from kbspark.llm.graph import components, extended


def brute(docs, k, num, den):
    """doc_id: (sizes, component) by comparing all pairs that share a shingle."""
    sets, root = [], {}
    for d, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w)))))))
        root.setdefault(d, d)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in having[g]:
                shared[j] += 1
            having[g].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for d, s in sets:
        out[d].add((len(s), find(d)))
    return out


def families(seed, sizes=(3, 7, 12, 20, 60, 150)):
    rnd = random.Random(seed)
    words, docs = [f"w{i}" for i in range(3000)], []
    for _ in range(30):
        base = [rnd.choice(words) for _ in range(rnd.choice(sizes))]
        for _ in range(rnd.choice((1, 2, 6, 20))):
            x = list(base)
            for _ in range(int(len(x) * rnd.uniform(0, 0.16))):
                i = rnd.randrange(len(x))
                x[i : i + rnd.randint(0, 1)] = [rnd.choice(words)]
            docs.append((3 * len(docs) + 1, " ".join(x)))
    return docs + [(docs[5][0], docs[40][1]), (docs[6][0], docs[6][1])]


@pytest.mark.parametrize("k, num, den, seed", [(1, 85, 100, 1), (2, 80, 100, 2), (4, 85, 100, 3)])
def test_components_equal_brute_force(spark, k, num, den, seed):
    docs = families(seed)
    want = brute(docs, k, num, den)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_components(df, k, num, den).collect()
    assert len(got) == len(docs)
    assert [r for r in got if (r.n_shingles, r.component_id) not in want[r.doc_id]] == []


@pytest.mark.parametrize("k, num, den, seed", [(1, 85, 100, 4), (4, 85, 100, 5)])
def test_hot_and_crowded_buckets_equal_brute_force(spark, monkeypatch, k, num, den, seed):
    for name, value in {"HOT_PART": 1 / 8, "ROW_LIMIT": 1, "HOT_LEAST": 4, "HOT_SHARE": 1e-6, "SALTS": 3, "CROWD": 0, "PART_ROWS": 3, "PART_PAIRS": 5}.items():
        monkeypatch.setattr(ngram_join, name, value)
    for name, value in {"HOT_LEAST": 2, "HOT_KEYS": 50}.items():
        monkeypatch.setattr(common, name, value)
        monkeypatch.setattr(graph, name, value)
    docs = families(seed)
    want = brute(docs, k, num, den)
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), k, num, den).collect()
    assert len(got) == len(docs) and [r for r in got if (r.n_shingles, r.component_id) not in want[r.doc_id]] == []


@pytest.mark.parametrize("crowd", [0, 32])
def test_tables_of_many_tasks_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(common, "TASK_ROWS", 64)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    docs = families(6)
    want = brute(docs, 4, 85, 100)
    got = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 4, 85, 100).collect()
    assert len(got) == len(docs) and [r for r in got if (r.n_shingles, r.component_id) not in want[r.doc_id]] == []


def test_a_small_table_draws_no_large_one_into_its_task(spark):
    large, small = spark.range(1000, numPartitions=4), common.packed(spark.range(5), 5)
    for side in ("merge", "shuffle_hash"):
        plan = large.join(small.hint(side), "id")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "hashpartitioning" in plan


def test_small_tables_take_few_tasks(spark):
    """However many partitions exchanges have."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame(families(7), "doc_id long, text string").repartition(5)
    sc = spark.sparkContext
    sc.setJobGroup("few tasks", "")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        ngram_join.ngram_components(docs, 4, 85, 100).collect()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(job).stageIds}
    assert 0 < sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 1500


def test_texts_of_a_template_are_not_all_compared(spark, monkeypatch):
    tested, mixed_buckets = [], ngram_join.mixed_buckets

    def noted(ask, have, on):
        mixed = ngram_join.stored(mixed_buckets(ask, have, on), "noted")
        pairs = F.col("pairs") if on[0] == "x" else F.when(F.col("pairs") <= ngram_join.CROWD * F.col("n"), F.col("pairs"))
        tested.append(mixed.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0])
        return mixed

    monkeypatch.setattr(ngram_join, "mixed_buckets", noted)
    words = [f"w{i}" for i in range(25)]
    sums = []
    for n in (500, 2000):  # one word of 25 differs, which is a similarity of 0.69; each tenth text has a near copy
        texts = [" ".join([*words[:12], f"x{i}", *words[13:]]) for i in range(n)]
        docs = list(enumerate(texts + [t + " more" for t in texts[::10]]))
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 4, 85, 100).collect()}
        assert got == {i: i if i < n else 10 * (i - n) for i in range(len(docs))}
        sums.append(sum(tested))
        tested.clear()
    assert sums[1] <= 8 * max(sums[0], 100)


def test_given_documents(documents, texts):
    want = brute(texts.items(), 4, 85, 100)
    got = ngram_join.ngram_components(documents, 4, 85, 100).collect()
    assert [r for r in got if (r.n_shingles, r.component_id) not in want[r.doc_id]] == [] and len(got) == len(texts)


def test_odd(odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(odd, 4, 85, 100).collect()}
    assert [got[d] for d in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert got[4] == (1, 4) and got[6][0] == 7 and got[None][1] is None
    assert ngram_join.ngram_components(empty).count() == 0
    assert ngram_join.keep_one_of_each(odd).columns == odd.columns and ngram_join.keep_one_of_each(odd).count() == odd.count()


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=80), st.sets(st.integers(0, 400), max_size=12), st.sets(st.integers(0, 400), max_size=12))
def test_similar_sets_share_what_the_units_promise(base, less, more):
    bands = shingles.Bands(85, 100)
    arr = lambda s: np.array(sorted(s), np.uint64)
    a, b = arr(base), arr((base - less) | more)
    if len(b) > len(a):
        a, b = b, a
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < 85 * (len(a) + len(b) - both) or not len(np.setxor1d(a, b)):
        return
    band = bands.of_size(len(b))
    need = dict(bands.probes(len(a)))[band]
    (_, ka, sa, da), (_, kb, sb, db) = bands.segment_keys(a, band), bands.segment_keys(b, band)
    equal = ka == kb
    deep = bool(equal[0]) or bool(set(da[sa == 0]) & {kb[0]}) or bool(set(db[sb == 0]) & {ka[0]})
    # units that a wrong choice of the others could have bought: all but need - 1 must hold something
    assert equal.sum() + deep >= len(ka) + 1 - (need - 1)
    assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in bands.sketch(a, band) ^ bands.sketch(b, band)) <= len(np.setxor1d(a, b))


def test_graph(spark, rnd):
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def rows_made(spark, run):
    """The most rows that the joins and generators of one of the plans that ``run`` executes make together, with its result."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    before, out = store.executionsCount(), run()
    bus.waitUntilEmpty()
    made = [0]
    for i in range(before, store.executionsCount()):
        e = store.executionsList().apply(i).executionId()
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        some = [nodes.apply(j) for j in range(nodes.size()) if re.search("Join|Generate", nodes.apply(j).name())]
        ids = {m.accumulatorId() for x in some for j in range(x.metrics().size()) if (m := x.metrics().apply(j)).name() == "number of output rows"}
        made.append(sum(int(values.apply(k).replace(",", "")) for k in ids if values.contains(k)))
    return max(made), out


def test_a_step_of_components_makes_no_more_rows_than_it_has_edges(spark, rnd):
    n = 4000  # a star, chains of 3 and pairs: enough for the form with hot nodes
    edges = [(1, i) for i in range(2, n)] + [(i, i + 1) for i in range(2 * n, 3 * n) if i % 4 < 3] + [(2 * i, 2 * i + 1) for i in range(2 * n, 3 * n)]
    edges = common.stored(spark.createDataFrame(edges, "a long, b long"), "given")
    most, got = rows_made(spark, lambda: components(edges).collect())
    assert len(got) == len({x for e in edges.collect() for x in e}) and 0 < most <= 3 * edges.count()  # a join for hot nodes and one for others; 21 times before


@pytest.mark.parametrize("hot", [1024, 2])
def test_further_edges_join_components(spark, monkeypatch, rnd, hot):
    for module in (common, graph):
        monkeypatch.setattr(module, "HOT_LEAST", hot)
        monkeypatch.setattr(module, "HOT_KEYS", 50 if hot == 2 else 4096)
    old = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(150)] + [(7, i) for i in range(500, 540)]
    new = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(40)] + [(700, i) for i in range(30)] + [(9, 9)]
    table = lambda edges: common.stored(spark.createDataFrame(edges, "a long, b long"), "given")
    label = components(table(old))
    got, want = ({r.node: r.component for r in x.collect()} for x in (extended(label, table(new)), components(table(old + new))))
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v} and set(want) <= set(got)
    assert extended(label, table(new).where("false")) is label
    few = table([(min(r.node for r in label.collect()), 10_000)])
    seen, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: (seen.append(edges.count()), whole(edges))[1])
    extended(label, few).collect()
    assert seen == [1]  # not all that was linked before


def test_the_filter_of_ids_is_small_and_loses_none(spark):
    ids = common.stored(spark.range(100_000).select((F.col("id") * 7).alias("b")), "ids")
    assert common.filter_rows(ids, "b", 1 << 23).count() <= (1 << 23) // (64 * common.FILTER_CELLS)  # a row per number before
    rows = spark.range(0, 1_400_000).withColumnRenamed("id", "a")
    kept = common.among(rows, "a", ids, "b")
    assert kept.columns == ["a"] and kept.where("a % 7 = 0 AND a < 700000").count() == 100_000 and kept.count() < 150_000
    assert common.among(rows, "a", ids.limit(0), "b").count() == 0
