import random
import subprocess

import pytest
from pyspark.sql import functions as F

from kbspark.functions.ignore import IgnoreRules
from kbspark.operators import ignored
from kbspark.plans.knowledge import AlreadyThere, KnowledgeBase, ignore_line
from kbspark.sources import files, git, store, toml_entries
from kbspark.streaming.incremental import counts_by_window, upsert_stream


def run(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    folder = tmp_path / "repo"
    folder.mkdir()
    run(folder, "init", "-q", "-b", "main")
    for i in range(4):
        (folder / "a.txt").write_text("".join(f"line{k}\n" for k in range(i + 1)))
        (folder / f"b{i}.py").write_text("x")
        run(folder, "add", ".")
        run(folder, "commit", "-q", "-m", f"Fix {i}\n\nbody")
    return folder


def test_git(spark, repo):
    spark.dataSource.register(git.GitCommits)
    rows = spark.read.format("git_commits").option("repo", str(repo)).load().orderBy("pos").collect()
    assert [r.message_summary for r in rows] == [f"Fix {i}" for i in range(4)]
    assert rows[0].parent_hashes == [] and rows[1].parent_hashes == [rows[0].hash] and rows[0].author == "Ann <a@b.c>"
    assert {d.path: (d.insertions, d.deletions) for d in rows[1].deltas} == {"a.txt": (1, 0), "b1.py": (1, 0)}
    assert [r[6] for r in git.read_commits(str(repo), since=rows[2].hash)] == ["Fix 3"]
    split = spark.read.format("git_commits").option("repo", str(repo)).option("commits_per_task", 3).load()
    assert split.rdd.getNumPartitions() == 2 and split.orderBy("pos").collect() == rows
    with pytest.raises(ValueError):
        list(git.read_commits(str(repo), since="nothing"))
    with pytest.raises(ValueError):
        list(git.read_commits(str(repo.parent)))


def test_git_merges_keep_their_places_in_parts(repo, tmp_path):
    run(repo, "checkout", "-q", "-b", "side", "HEAD~2")
    (repo / "side.py").write_text("y\n")
    run(repo, "add", ".")
    run(repo, "commit", "-q", "-m", "Side")
    run(repo, "checkout", "-q", "main")
    run(repo, "merge", "-q", "--no-ff", "-m", "Merge", "side")
    whole = list(git.read_commits(str(repo)))
    assert [r[7] for r in whole] == [1, 2, 3, 4, 5, 6] and whole[-1][8] == [("side.py", 1, 0)]
    for size in (1, 2, 4, 6):
        assert [r for p in git.parts_of_history(str(repo), size=size) for r in git.walk(str(repo), *p)] == whole
    (tmp_path / "none").mkdir()
    run(tmp_path / "none", "init", "-q", "-b", "main")
    assert list(git.read_commits(str(tmp_path / "none"))) == []


def test_commits_as_a_stream(spark, repo, tmp_path):
    """Each commit comes once: over restarts, and after the last commits have been written anew."""
    spark.dataSource.register(git.GitCommits)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        stream = spark.readStream.format("git_commits").option("repo", str(repo)).option("commits_per_task", 3).load()
        stream.select("hash", "pos", "message_summary").writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.pos, r.message_summary) for r in spark.read.parquet(out).collect())

    first = [(i + 1, f"Fix {i}") for i in range(4)]
    assert drain() == first and drain() == first
    (repo / "c.py").write_text("x")
    run(repo, "add", ".")
    run(repo, "commit", "-q", "-m", "More")
    assert drain() == [*first, (5, "More")]
    run(repo, "commit", "-q", "--amend", "-m", "More, written anew")
    (repo / "d.py").write_text("x")
    run(repo, "add", ".")
    run(repo, "commit", "-q", "-m", "Last")
    assert drain() == sorted([*first, (5, "More"), (5, "More, written anew"), (6, "Last")])


def test_files(spark, repo):
    (repo / "bin").write_bytes(b"\0\1")
    (repo / ".gitignore").write_text("*.log\n")
    (repo / "x.log").write_text("l")
    got = {r.path: r for r in files.repo_files(spark, str(repo)).collect()}
    assert "x.log" in {r.path for r in files.repo_files(spark, str(repo), gitignore=False).collect()}
    assert set(got) == {"a.txt", ".gitignore", *(f"b{i}.py" for i in range(4))}
    assert got["b0.py"]["size"] == 1 and got["b0.py"].text == "x"


def test_files_in_deep_folders(spark, repo):
    (repo / ".gitignore").write_text("build/\n*.log\n")
    paths = ["a/b/c/d/deep.txt", "a/b/c/d/deep.log", "a/b/two.txt", "a/one.txt", "build/x.txt", "a/build/y.txt", "a/b/c/build/z.txt", ".kb/k.toml", "a/b/c/.kb/k.toml", ".hidden/h.txt"]
    for p in paths:
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(p)
    (repo / "a/empty").mkdir()
    got = {r.path: r.text for r in files.repo_files(spark, str(repo)).where("contains(path, '/')").collect()}
    assert got == {p: p for p in ("a/b/c/d/deep.txt", "a/b/two.txt", "a/one.txt", ".hidden/h.txt")}


def test_toml(spark, tmp_path):
    rows = [("facts", "s1", 'a "q"\\', "b\nc", "é\t", ["f"], [], ["d"], {"k": "v"}), ("bugs", "s2", "x", "y", "z", [], [], [], {})]
    df = spark.createDataFrame(rows, "category string, slug string, what string, why string, how string, files array<string>, commits array<string>, dependencies array<string>, outcome map<string,string>")
    toml_entries.write_entries(df, str(tmp_path / "kb"))
    (tmp_path / "kb/facts/bad.toml").write_text("what = 1")
    got = {r.file_name: r for r in toml_entries.read_entries(spark, str(tmp_path / "kb")).collect()}
    assert set(got) == {"s1.toml", "s2.toml"}
    assert tuple(got["s1.toml"])[2:] == rows[0][2:] and got["s1.toml"].category == "facts"


def test_store(spark, tmp_path):
    assert store.read_table(spark, str(tmp_path), "t", "n long").count() == 0
    for n in (1, 2):
        have = store.read_table(spark, str(tmp_path), "t", "n long")
        store.write_table(have.unionByName(spark.range(n).withColumnRenamed("id", "n")), str(tmp_path), "t")
    assert store.read_table(spark, str(tmp_path), "t", "n long").count() == 3


def test_ignore_line():
    assert ignore_line(None) == ".kb/\n" and ignore_line("a\n") == "a\n.kb/\n" and ignore_line(" .kb/ \nb") == " .kb/ \nb"


ANSWER = '[[entry]]\nwhat = "Use pool"\nwhy = "fast"\nhow = "pool"\n'


def test_learn(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.init()
    with pytest.raises(AlreadyThere):
        kb.init()
    f = spark.createDataFrame([("a.py", "h", 1, "text")], "path string, hash string, size long, text string")
    h = spark.createDataFrame([("c1", 1, "Breaking change", 1)], "hash string, pos long, message string, n_parents int")
    d = spark.createDataFrame([("c1", "core/x", 900, 0)], "hash string, path string, insertions long, deletions long")
    assert not kb.status(f, h).first().up_to_date
    counts = kb.learn(f, h, d, {"claude": lambda p: ANSWER, "codex": lambda p: ANSWER.replace("pool", "pools", 1)})
    assert {r.action: r["count"] for r in counts.collect()} == {"written": 1}
    assert kb.ask("POOL").first().category == "facts"
    assert kb.status(f, h).first().up_to_date
    assert kb.learn(f, h, d, {"claude": lambda p: ANSWER}).count() == 0


def test_learn_asks_of_files_commits_and_patterns(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.init()
    told = tmp_path / "told"
    told.mkdir()

    def provider(prompt):
        (told / str(len(list(told.iterdir())))).write_text(prompt)
        return ANSWER

    def asked():
        found = [p.read_text() for p in told.iterdir()]
        for p in told.iterdir():
            p.unlink()
        return sorted(found)

    body = "path string, hash string, size long, text string"
    f = spark.createDataFrame([(p, "h", 1, f"text of {p}") for p in ("a.py", "b.py", "c.py")], body)
    h = spark.createDataFrame([("c" * 40, 1, "Breaking change\n\nmore", 1)], "hash string, pos long, message string, n_parents int")
    d = spark.createDataFrame([("c" * 40, "core/x", 900, 7)], "hash string, path string, insertions long, deletions long")
    store.write_table(spark.createDataFrame([("a.py", "h", 1, "p1"), ("b.py", "h", 1, "p1"), ("b.py", "h", 1, "p2"), ("c.py", "h", 1, "p3")], "path string, hash string, size long, pattern_id string"), kb.root, "files")
    links = lambda: sorted((r.path, r.pattern_id) for r in store.read_table(spark, kb.root, "files", "path string, hash string, size long, pattern_id string").collect())

    kb.learn(f, h, d, {"m": provider})  # only a commit is new
    (prompt,) = asked()
    assert "ccccccc by unknown: Breaking change\n  files 1, lines +900 -7\n" in prompt and "## " not in prompt
    assert links() == [("a.py", "p1"), ("b.py", "p1"), ("b.py", "p2"), ("c.py", "p3")]

    f2 = f.withColumn("hash", F.when(F.col("path") == "a.py", "new").otherwise(F.col("hash"))).where("path <> 'c.py'")
    kb.learn(f2, h, d, {"m": provider})  # a.py differs, c.py is gone, and p3 with it has no file left
    changed, patterns = asked()
    assert "## a.py" in changed and "## b.py" not in changed
    assert "- p1\n- p3\n" in patterns and "- p2" not in patterns and "## a.py" in patterns and "## b.py" in patterns
    assert links() == [("a.py", None), ("b.py", "p1"), ("b.py", "p2")]

    kb.learn(f2.where("path = 'b.py'"), h, d, {"m": provider}, need_success=True)  # a file without patterns is gone
    assert asked() == [] and links() == [("b.py", "p1"), ("b.py", "p2")]


def test_learn_keeps_changes_made_meanwhile(spark, tmp_path):
    """What a file becomes while models are asked is found by the next run; the manifest has what they were shown."""
    kb, code = KnowledgeBase(spark, str(tmp_path / "kb")), tmp_path / "code"
    kb.init()
    code.mkdir()
    (code / "a.py").write_text("one")
    body = "hash string, pos long, message string, n_parents int", "hash string, path string, insertions long, deletions long"
    h, d = (spark.createDataFrame([], x) for x in body)
    seen = tmp_path / "seen"

    def provider(prompt):
        seen.write_text(prompt)
        (code / "a.py").write_text("two")
        return ANSWER

    kb.learn(files.repo_files(spark, str(code)), h, d, {"m": provider})
    assert "one" in seen.read_text()
    assert [tuple(r) for r in kb.drift(files.repo_files(spark, str(code)), h, d).collect()] == [("modified", "a.py", None)]


def test_drift_links_and_touched_patterns(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.init()
    f = spark.createDataFrame([(p, "h", 1, "text") for p in ("a.py", "b.py")], "path string, hash string, size long, text string")
    h = spark.createDataFrame([("c" * 40, 1, "Breaking change\n\nmore", 1)], "hash string, pos long, message string, n_parents int")
    d = spark.createDataFrame([("c" * 40, "core/x", 900, 7)], "hash string, path string, insertions long, deletions long")
    drift = lambda x: sorted(tuple(r) for r in kb.drift(x, h, d).collect())
    assert drift(f) == [("commit", "ccccccc", "Breaking change"), ("new", "a.py", None), ("new", "b.py", None)]
    kb.learn(f, h, d, {"m": lambda p: ANSWER})
    assert drift(f) == []
    kb.link(spark.createDataFrame([("p1", "one"), ("p2", "two")], "pattern_id string, name string"), spark.createDataFrame([("p1", "a.py"), ("p2", "b.py"), ("p2", "gone.py"), ("p9", "a.py")], "pattern_id string, path string"))
    links = lambda: sorted((r.pattern_id, r.path) for r in store.read_table(spark, kb.root, "links", "pattern_id string, path string").collect())
    dates = lambda: {r.pattern_id: (r.created, r.last_updated) for r in store.read_table(spark, kb.root, "patterns", "pattern_id string, name string, created timestamp, last_updated timestamp").collect()}
    before = dates()
    assert links() == [("p1", "a.py"), ("p2", "b.py")] and set(before) == {"p1", "p2"} and drift(f) == []
    f2 = f.withColumn("hash", F.when(F.col("path") == "a.py", "new").otherwise(F.col("hash")))
    assert drift(f2) == [("modified", "a.py", None), ("pattern", "p1", None)]
    kb.learn(f2, h, d, {"m": lambda p: ANSWER})
    after = dates()
    assert after["p1"][0] == before["p1"][0] and after["p1"][1] > before["p1"][1] and after["p2"] == before["p2"]
    assert links() == [("p2", "b.py")] and drift(f2) == []


def test_ignore_rules_equal_git(tmp_path):
    """Random rules and paths, judged by git as well."""
    rnd = random.Random(5)
    names = ["a", "b", "ab", "a.b", "x y", "a]", "#a", "!b", "é", "B"]
    pieces = ["a", "b", "ab", "*", "?", "a*", "*b", "**", "[ab]", "[!a]", "[a-c]*", "[[:alpha:]]", "\\#a", "\\!b", "a.b", "*.b", "x\\ y", "[^b]?", "a**b", "[]a]", "[a", "\\", "é", "***", "[b-a]"]
    for n in range(25):
        top = tmp_path / str(n)
        top.mkdir()
        run(top, "init", "-q")
        paths = {"/".join(rnd.choice(names) for _ in range(rnd.choice((1, 2, 3, 4)))) for _ in range(50)}
        folders = {"/".join(p.split("/")[:i]) for p in paths for i in range(1, p.count("/") + 1)}
        leaves = sorted(paths - folders)
        line = lambda: rnd.choice(("", "", "!")) + rnd.choice(("", "/")) + "/".join(rnd.choice(pieces) for _ in range(rnd.choice((1, 1, 2, 3)))) + rnd.choice(("", "", "/", " ", "\r"))
        rules = {f: "\n".join(line() for _ in range(3)) for f in ["", *rnd.sample(sorted(folders), min(3, len(folders)))]}
        for p in leaves:
            (top / p).parent.mkdir(parents=True, exist_ok=True)
            (top / p).write_text("")
        for f, content in rules.items():
            (top / f / ".gitignore").write_bytes(content.encode())
        done = subprocess.run(["git", "-C", str(top), "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(leaves).encode(), capture_output=True)
        known = IgnoreRules(rules)
        assert {p for p in leaves if known.ignores(p)} == {p.decode() for p in done.stdout.split(b"\0") if p}, rules


def test_ignored_files_of_tables(spark, monkeypatch):
    paths = spark.createDataFrame([("a/x.log", 1), ("a/keep.log", 2), ("b/", 3), ("b/c", 4), ("a/b", 5), (None, 6)], "path string, n int")
    rules = spark.createDataFrame([("", "*.log\nb/\n"), ("a", "!keep.log\n"), (None, "*"), ("z", None)], "folder string, content string")
    assert sorted(r.n for r in ignored.ignored_files(paths, rules).collect()) == [1, 3, 4]
    assert ignored.ignored_files(paths, rules.limit(0)).count() == 0
    monkeypatch.setattr(ignored, "MOST_BYTES", 3)
    with pytest.raises(ValueError):
        ignored.ignored_files(paths, rules)


def test_ignored_files_sees_paths_alone(spark, tmp_path):
    spark.createDataFrame([("a.log", "x" * 1000), ("b", "y" * 1000)], "path string, text string").write.parquet(str(tmp_path / "files"))
    rules = spark.createDataFrame([("", "*.log\n")], "folder string, content string")
    got = ignored.ignored_files(spark.read.parquet(str(tmp_path / "files")), rules)
    assert [(r.path, len(r.text)) for r in got.collect()] == [("a.log", 1000)]
    assert "ReadSchema: struct<path:string>" in got.select("path")._jdf.queryExecution().executedPlan().toString()


def test_ignore_files_of_inner_folders(spark, tmp_path):
    for p, body in {".gitignore": "*.log\nout/\n", "a/.gitignore": "!keep.log\n/x\n", "a/keep.log": "k", "a/no.log": "n", "a/x": "x", "a/b/x": "y", "a/b/c/.gitignore": "z", "a/b/c/z": "z", "a/b/c/d/e/z": "z", "a/b/c/d/e/w": "w", "out/keep": "o"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    assert {r.path for r in files.repo_files(spark, str(tmp_path)).collect()} == {".gitignore", "a/.gitignore", "a/keep.log", "a/b/x", "a/b/c/.gitignore", "a/b/c/d/e/w"}


def test_stream(spark, tmp_path):
    src, root, check = (str(tmp_path / x) for x in ("src", "root", "check"))
    for body in ("one", "two"):
        spark.createDataFrame([(1, "Use pool", "y", body), (2, None, "y", "z")], "seq long, what string, why string, how string").write.mode("append").parquet(src)
        upsert_stream(spark, src, root, check).awaitTermination()
        table = store.read_table(spark, root, "entries", "category string, slug string, what string, how string").collect()
        assert [(r.slug, r.how) for r in table] == [("use-pool", body)]
    events = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'error' AS event_type")
    assert counts_by_window(events).select(F.sum("n")).first()[0] == 1
