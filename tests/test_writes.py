"""The entry source, tables of buckets, and calls of providers at once."""

import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains

from kbspark.operators import entries, prompts
from kbspark.sources import entry_source, store, toml_entries

WRITTEN = "category string, slug string, what string, why string, how string, files array<string>, commits array<string>, dependencies array<string>, outcome map<string,string>"
KEYED = "category string, slug string, what string"


def rows(n, category=lambda i: ("bugs", "facts")[i % 2]):
    return [(category(i), f"s{i}", f"what {i}", "why", "how", [f"f{i}"], [], [], {}) for i in range(n)]


@pytest.fixture
def kb(spark, tmp_path):
    toml_entries.write_entries(spark.createDataFrame(rows(20), WRITTEN).repartition(4), str(tmp_path / "kb"))
    return tmp_path / "kb"


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_filters_keep_files_closed(spark, kb, monkeypatch):
    opened = []
    plain = entry_source._store

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            if name == "open_input_file":
                return lambda path: opened.append(path) or self.inner.open_input_file(path)
            return getattr(self.inner, name)

    monkeypatch.setattr(entry_source, "_store", lambda root: (Counting(plain(root)[0]), plain(root)[1]))
    for filters, want in (([], 20), ([EqualTo(("category",), "bugs")], 10), ([In(("category",), ("facts", "other"))], 10), ([EqualTo(("category",), "bugs"), In(("file_name",), ("s2.toml", "s3.toml"))], 1)):
        opened.clear()
        reader = entry_source.EntryReader(str(kb), 300)
        assert list(reader.pushFilters([*filters, StringContains(("what",), "x")])) == [StringContains(("what",), "x")]
        parts = reader.partitions()
        assert sum(len(list(reader.read(p))) for p in parts) == want == len(opened)
        assert len(parts) == max(1, len([p for p in parts if p.value])) and (want < 10 or len(parts) > 2)


def test_the_source_equals_the_reader_of_all_files(spark, kb):
    (kb / "bugs/broken.toml").write_text("what = 1")
    entry_source.register(spark)
    df = spark.read.format("kb_entries").load(str(kb))
    plain = toml_entries.read_entries(spark, str(kb))
    assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect()))
    some = df.where("category = 'bugs' AND file_name IN ('s2.toml', 's4.toml', 's5.toml') AND what <> 'what 4'")
    assert [(r.category, r.file_name) for r in some.collect()] == [("bugs", "s2.toml")]
    assert df.where("category = 'none'").count() == 0


def test_a_failed_write_leaves_the_old_files(spark, kb):
    before = {p: (kb / p).read_text() for p in names(kb)}
    bad = F.when(F.col("slug") == "s7", F.raise_error(F.lit("no"))).otherwise(F.lit("changed"))
    df = spark.createDataFrame(rows(20), WRITTEN).repartition(4).withColumn("what", bad.cast("string"))
    with pytest.raises(Exception, match="no"):
        toml_entries.write_entries(df, str(kb))
    assert {p: (kb / p).read_text() for p in names(kb)} == before


def test_repeated_attempts_leave_no_doubles(tmp_path):
    from pyspark.sql import Row

    (tmp_path / "bugs").mkdir()
    writer = entry_source.EntryWriter(str(tmp_path), False)
    r = [Row(category="bugs", slug=f"s{i}", what="w", why="y", how="h") for i in range(3)]
    writer.write(iter(r[:2]))  # an attempt that was lost
    writer.commit([writer.write(iter(r)), None])
    assert names(tmp_path) == ["bugs/s0.toml", "bugs/s1.toml", "bugs/s2.toml"] and not list(tmp_path.glob(".staging-*"))


def test_overwrite_replaces_all(spark, kb):
    entry_source.register(spark)
    spark.createDataFrame(rows(2), WRITTEN).write.format("kb_entries").mode("overwrite").save(str(kb))
    assert names(kb) == ["bugs/s0.toml", "facts/s1.toml"]


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_upserts_write_what_changes(spark, tmp_path):
    root, now = str(tmp_path), {}
    table = lambda: {(r.category, r.slug): r.what for r in store.read_table(spark, root, "t", KEYED).collect()}
    whole = {("bugs", f"s{i}"): f"what {i} " * 20 for i in range(3000)}
    for n, batch in enumerate((whole, {("bugs", "s5"): "new"}, {("facts", "s5"): "other", ("bugs", "s6"): None})):
        reader = store.read_table(spark, root, "t", KEYED)
        before = size(tmp_path)
        got = store.upsert_buckets(spark.createDataFrame([(*k, v) for k, v in batch.items()], KEYED), root, "t", ("category", "slug"), KEYED, buckets=64)
        assert got == n + 1 and reader.count() == len(now)  # a reader goes on with the version that it began with
        now |= batch
        assert table() == now
        assert n == 0 or size(tmp_path) - before < before / 10
    assert store.vacuum(spark, root, "t", keep=1) == 3 and table() == now and store.vacuum(spark, root, "t", keep=1) == 0


def test_a_second_writer_of_the_same_commit_fails(spark, tmp_path):
    root = str(tmp_path)
    batch = spark.createDataFrame([("bugs", "a", "x")], KEYED)
    store.upsert_buckets(batch, root, "t", ("category", "slug"), KEYED)
    record = store._last_record(spark, f"{root}/t")
    with pytest.raises(RuntimeError):
        store._publish(spark, f"{root}/t", record)
    assert store.read_table(spark, root, "t", KEYED).count() == 1


def test_a_table_of_versions_becomes_one_of_buckets(spark, tmp_path):
    root = str(tmp_path)
    store.write_table(spark.createDataFrame([("bugs", "a", "x"), ("bugs", "b", "y")], KEYED), root, "t")
    store.upsert_buckets(spark.createDataFrame([("bugs", "a", "z")], KEYED), root, "t", ("category", "slug"), KEYED)
    assert sorted(map(tuple, store.read_table(spark, root, "t", KEYED).collect())) == [("bugs", "a", "z"), ("bugs", "b", "y")]


def test_answers_come_in_the_order_of_prompts_and_providers(spark):
    asked = spark.createDataFrame([("p", f"prompt {i}", i) for i in range(6)], "prompt_type string, prompt string, no long").repartition(3)

    def slow(prompt):
        time.sleep(0.02 * (7 - int(prompt[-1])))
        return f"slow {prompt}"

    got = prompts.fan_out(asked, {"z": slow, "a": lambda p: f"fast {p}"}).orderBy("seq").collect()
    assert [(r.model, r.response) for r in got] == [x for i in range(6) for x in (("z", f"slow prompt {i}"), ("a", f"fast prompt {i}"))]


def test_no_more_calls_than_allowed_are_under_way(spark, tmp_path):
    log = str(tmp_path / "log")

    def provider(prompt):
        with open(log, "a") as f:
            f.write(f"+ {time.monotonic()}\n")
        time.sleep(0.1)
        with open(log, "a") as f:
            f.write(f"- {time.monotonic()}\n")
        return prompt

    asked = spark.range(12).select(F.lit("p").alias("prompt_type"), F.col("id").cast("string").alias("prompt")).coalesce(1)
    assert prompts.fan_out(asked, {"m": provider}, at_once=3).where("error is null").count() == 12
    under_way = most = 0
    for line in sorted(open(log), key=lambda x: float(x.split()[1])):
        under_way += 1 if line[0] == "+" else -1
        most = max(most, under_way)
    assert 2 <= most <= 3


def test_a_rate_limit_holds_all_calls_of_its_model():
    waits, calls = prompts.Waits(60.0), []

    def provider(prompt):
        calls.append((prompt, time.monotonic()))
        if len(calls) == 1:
            raise RuntimeError("HTTP 429, retry after 1 seconds")
        return prompt

    began = time.monotonic()
    one = threading.Thread(target=lambda: prompts.call(provider, "a", 3, 0.0, 5.0, waits, "m"))
    one.start()
    time.sleep(0.3)
    assert prompts.call(provider, "b", 3, 0.0, 5.0, waits, "m") == ("b", None)
    one.join()
    assert [c[0] for c in calls][0] == "a" and all(t - began >= 0.99 for _, t in calls[1:]) and len(calls) == 3


def test_payloads_are_decoded(spark):
    asked = spark.createDataFrame([("p", "x")], "prompt_type string, prompt string")
    said = {"plain": lambda p: "text", "json": lambda p: '{"agent_message": "inner"}', "bad": lambda p: "{}"}
    got = {r.model: (r.response, r.error) for r in prompts.fan_out(asked, said, payloads=("json", "bad")).collect()}
    assert got == {"plain": ("text", None), "json": ("inner", None), "bad": (None, "the payload has no message")}


def test_appended_items(spark):
    df = spark.createDataFrame([(["a"], None, {"k": "1"}, "x"), (None, ["c"], None, None)], "files array<string>, commits array<string>, outcome map<string,string>, new string")
    got = entries.appended(df, files=F.col("new"), commits=F.lit("z"), outcome={"k": F.col("new"), "l": F.lit("2")}).collect()
    assert [(r.files, r.commits, r.outcome) for r in got] == [(["a", "x"], ["z"], {"k": "x", "l": "2"}), ([], ["c", "z"], {"l": "2"})]
