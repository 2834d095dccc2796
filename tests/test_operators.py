import random

import pytest
from pyspark.sql import functions as F

from kbspark import queries
from kbspark.operators import changes, commits, entries, prompts, search, synthesis

ENTRY = "seq long, category string, file_name string, what string, why string, how string"


def test_search(spark):
    e = spark.createDataFrame([(1, "decisions", "a.toml", "Use tokio", "fast", "anyhow"), (2, "bugs", "b.toml", "Leak", "tokio task", "x"), (3, "facts", "c.toml", "use anyhow", "y", "ANYHOW.")], ENTRY)
    assert [r.file_path for r in search.ask(e, "TOKIO").collect()] == ["decisions/a.toml", "bugs/b.toml"]
    assert search.ask(e, "anyhow").collect()[0].matched_fields == ["what", "how"]
    assert search.ask(e, "o", max_results=1).count() == 1 and search.ask(e, "o", category="bugs").count() == 1
    assert search.ask(e, "how.").count() == 1 and search.ask(e, "").count() == 3
    assert search.get_entry(e, "bugs", "../a").count() == 0
    assert {r.category: r.n for r in search.list_categories(e).collect()} == {"decisions": 1, "bugs": 1, "facts": 1, "migrations": 0, "patterns": 0}


def test_context_lines(spark):
    c = spark.sql("SELECT struct(array('a','b') AS files, CAST(array() AS array<string>) AS commits, array('d') AS dependencies) AS c")
    assert c.select(search.context_lines(F.col("c"))).first()[0] == "Files: a, b\nDependencies: d"


def test_write_actions(spark):
    batch = spark.createDataFrame([(1, "facts", "s", "a", "b", "c"), (2, "facts", "s", "a", "b", "c"), (3, "facts", "s", "a", "b", "d"), (4, "facts", "t", "x", None, "z")], "seq long, category string, slug string, what string, why string, how string")
    none = spark.createDataFrame([], "category string, slug string, body string")
    assert [r.action for r in entries.write_actions(batch, none).orderBy("seq").collect()] == ["written", "skipped", "updated", "written"]
    kept = entries.last_of_each_key(entries.body_of(batch))
    assert {r.how for r in kept.collect()} == {"d", "z"}
    assert [r.action for r in entries.write_actions(batch.where("seq > 2"), kept).orderBy("seq").collect()] == ["skipped", "skipped"]
    assert entries.upsert(kept, kept).count() == 2


def test_scan(spark):
    files = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "path string, hash string, size long")
    manifest = spark.createDataFrame([("a", "1", "p"), ("b", "x", "p"), ("d", "4", "q")], "path string, hash string, pattern_id string")
    got = {r.path: (r.status, r.is_new, r.is_changed) for r in changes.scan_changes(files, manifest).collect()}
    assert got == {"a": ("unchanged", False, False), "b": ("modified", False, True), "c": ("new", True, False)}
    assert all(r.is_changed for r in changes.scan_changes(files, manifest, full=True).collect())
    assert [r.path for r in changes.deleted(files, manifest).collect()] == ["d"]
    assert [r.pattern_id for r in changes.invalidated_patterns(files, manifest).collect()] == ["p", "q"]
    assert changes.scan_counts(files, manifest).first().asDict() == {"total": 3, "changed": 2, "unchanged": 1, "deleted": 1}
    hidden = spark.createDataFrame([("x/.git/a",), (".kb",), ("a.kb",), ("agit/b",)], "path string")
    assert {r.path for r in changes.visible(hidden).collect()} == {"a.kb", "agit/b"}


SCORES = [((1, 1, 0), 1, "m", "Low"), ((1, 300, 300), 1, "breaking change", "Critical")]


def score(spark, rows, deltas):
    c = spark.createDataFrame(rows, "hash string, message string, n_parents int")
    d = spark.createDataFrame(deltas, "hash string, path string, insertions long, deletions long")
    return {r.hash: r for r in commits.score_commits(c, d).collect()}


def test_scores(spark):
    rows = [("big", "Breaking change: drop it", 1), ("root", "initial", 0), ("merge", "refactor", 2), ("docs", "typo", 1), ("edge", "docs", 1), ("none", "", 1)]
    deltas = [("big", "migrations/1.sql", 600, 0), ("docs", "README.md", 20, 0), ("docs", "docs/a.md", 20, 0), ("edge", ".gitignore", 900, 1)]
    got = score(spark, rows, deltas)
    assert got["big"].category == "Critical" and got["big"].pattern == "migrations/" and got["big"].keyword == "breaking change"
    assert got["root"].category == "Low" and got["root"].lines is None and got["root"].pattern is None
    assert abs(got["merge"].significance - (0.35 + 0.24)) < 1e-6
    assert got["docs"].diff_score == pytest.approx(0.15) and got["docs"].pattern == "README"
    assert got["edge"].category == "Medium"  # 0.3 + 0.04 + 0.06 is just the limit
    assert got["none"].significance == pytest.approx(0.3 * 0.05)


def test_walk(spark):
    c = spark.createDataFrame([(f"c{i}", i, 2 if i == 3 else 1) for i in range(1, 7)], "hash string, pos long, n_parents int")
    page = lambda **k: [(r.pos, r.is_next) for r in commits.walk_page(c, **k).orderBy("pos").collect()]
    assert page(limit=3) == [(1, False), (2, False), (3, False), (4, True)]
    assert page(limit=2, merges=False) == [(1, False), (2, False), (3, True)]
    assert page(limit=0) == [(1, True)] and page(after=3) == [(4, False), (5, False), (6, False)] and page(limit=10)[-1] == (6, False)
    m = spark.createDataFrame([("c2", 20), ("c5", 50)], "sha string, processed_at long")
    assert [r.pos for r in commits.new_prefix(c, m).collect()] == [6]
    assert [r.sha for r in commits.commits_since(m, "c2").collect()] == ["c5"] and commits.commits_since(m, "no").count() == 0
    assert commits.commit_counts(c, m).first().asDict() == {"total": 5, "processed": 2, "unprocessed": 3}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_cluster_is_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("xy"), "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    leaders, want = {}, {}
    for seq, cat, what in rows:
        hit = next((s for s, w in leaders.get(cat, []) if edits(w, what) < 3), None)
        if hit is None:
            leaders.setdefault(cat, []).append((seq, what))
        want[seq] = seq if hit is None else hit
    df = spark.createDataFrame(rows, "seq long, category string, what string").repartition(3)
    assert {r.seq: r.cluster_id for r in synthesis.cluster(df).collect()} == want


def clustered(spark, rows):
    return spark.createDataFrame([(1, i, m, w, y, h) for i, (m, w, y, h) in enumerate(rows)], "cluster_id long, seq long, model string, what string, why string, how string")


def test_merge(spark):
    c = clustered(spark, [("claude", "Use connection pooling", "Performance boost. Less overhead", "Step 1\nStep 2"), ("gemini", "Use pooling", "Performance boost. Better throughput", "Step 1\nStep 3"), ("codex", "Use pooling", "", "")])
    assert synthesis.merge_what(c).first().what == "Use pooling"
    assert synthesis.merge_why(c).first().why == "Performance boost. Less overhead. Better throughput"
    assert synthesis.merge_how(c).first().how == "Step 1\nStep 2\nStep 3"
    one = clustered(spark, [("claude", "A", "x. x. y.", "h")])
    assert synthesis.synthesize(one).first().why == "x. x. y."


def test_parts_in_one_pass(spark):
    rows = [(1, 0, "b. a", "s\n\nt", ["y", None]), (1, 1, "a. c", "t\nr", ["x", "y"]), (2, 2, None, "", None), (3, 3, "a. a", None, [])]
    c = spark.createDataFrame(rows, "cluster_id long, seq long, why string, how string, files array<string>")
    got = {r.cluster_id: (r.why, r.how, r.files) for r in synthesis.merge_parts(c, ["files"]).collect()}
    assert got == {1: ("b. a. c", "s\nt\nr", ["x", "y"]), 3: ("a", None, None)}
    for name, one in (("why", synthesis.merge_why(c)), ("how", synthesis.merge_how(c)), ("files", synthesis.merge_list(c, "files"))):
        at = ("why", "how", "files").index(name)
        assert {r.cluster_id: r[name] for r in one.collect() if r[name]} == {k: v[at] for k, v in got.items() if v[at]}


@pytest.mark.parametrize(
    "said, want",
    [
        ([("claude", "A"), ("gemini", "A"), ("codex", "B")], ("majority", "A", None, 23)), ([("claude", "A"), ("gemini", "B"), ("codex", "C")], ("highest_weight", "A", "claude", 12)),
        ([("claude", "Use Pooling"), ("gemini", "use pooling")], ("majority", "Use Pooling", None, 23)), ([("other", "A")], ("merged", None, None, None)), ([], None),
    ],
)
def test_vote(spark, said, want):
    rows = spark.createDataFrame([(1, "what", i, m, v) for i, (m, v) in enumerate(said)], "cluster_id long, field string, seq long, model string, value string")
    got = synthesis.vote(rows).select("kind", "winner", "model", "tenths").collect()
    assert (tuple(got[0]) if got else None) == want


GOOD = 'what = "a"\nwhy = "b"\nhow = "c"'


@pytest.mark.parametrize(
    "raw, n",
    [(GOOD, 1), (f"[[entry]]\n{GOOD}\n[[entry]]\n{GOOD}", 2), (f"{GOOD}\n---\n{GOOD}", 2), (f"{GOOD}\n---\nbad", 1), ("", 0), ("garbage", 0), (f"[[entry]]\n{GOOD}\n[[entry]]\nwhat = 1", 0), (f"```toml\n{GOOD}\n```", 0), (None, 0)],
)
def test_parse(spark, raw, n):
    rows = spark.createDataFrame([(1, "m", raw)], "seq long, model string, response string")
    assert prompts.parse_responses(rows).where("error is null").count() == n


def test_parse_fences(spark):
    rows = spark.createDataFrame([(1, "m", f"```toml\n{GOOD}\n```")], "seq long, model string, response string")
    assert prompts.parse_responses(rows, strip_fences=True).where("error is null").count() == 1


def boom(_):
    raise RuntimeError("401 unauthorized")


def test_fan_out(spark):
    p = spark.createDataFrame([("files", "p")], "prompt_type string, prompt string")
    got = {r.model: (r.response, r.error) for r in prompts.fan_out(p, {"a": lambda x: x + "!", "b": boom}, wait_s=0.0).collect()}
    assert got == {"a": ("p!", None), "b": (None, "401 unauthorized")}
    with pytest.raises(ValueError):
        prompts.fan_out(p, {})


def test_prompt_limits(spark):
    many = spark.createDataFrame([(f"f{i:03}", 1, "\n".join(map(str, range(500 if i == 0 else 1)))) for i in range(60)], "path string, size long, text string")
    got = prompts.prompt_files(many).first().prompt
    assert "[10 further files left out]" in got and "[300 further lines left out]" in got and "f050" not in got
    ids = spark.createDataFrame([("p1",)], "pattern_id string")
    assert "- p1\n" in prompts.prompt_patterns(ids, many).first().prompt


def test_calls_of_local_providers_are_dealt_to_tasks(spark):
    asked = spark.range(2000).select(F.lit("t").alias("prompt_type"), F.col("id").cast("string").alias("prompt"), F.col("id").alias("no"))
    local = {"same": lambda p: p, "twice": lambda p: p + p}
    got = prompts.fan_out(asked, local, tasks=8).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.seq, r.model, r.response) for r in got) == sorted((2 * i + k, m, str(i) * (k + 1)) for i in range(2000) for k, m in enumerate(local))
    sizes = [sum(r.task == t for r in got) for t in {r.task for r in got}]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert queries.QUERIES["provider_answers"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() > 2  # one task for each model before
