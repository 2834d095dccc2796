"""Search through the index against search in all texts."""

import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.adapters import view
from kbspark.operators import search, search_index
from kbspark.operators.search_index import SearchIndex

SF = "/root/testdata/sf0.01"
SCHEMA = "category string, file_name string, what string, why string, how string"


def test_codes():
    rnd = random.Random(1)
    for _ in range(50):
        numbers = sorted(rnd.sample(range(1 << rnd.choice((7, 16, 30))), rnd.randrange(1, 100)))
        assert search_index.decode(search_index.encode(numbers)).tolist() == numbers
    assert search_index.decode(b"").tolist() == [] and len(search_index.encode(list(range(1000)))) == 1000


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), block_rows=16)
    found.upsert(view(spark, SF, "entries"))
    return found


def test_a_rare_literal_reads_few_texts(spark, index):
    entries = view(spark, SF, "entries")
    literal = "heenbl"
    want = search.ask(entries, literal, 1000).collect()
    assert 0 < len(want) < 60 and index.ask(literal, 1000).collect() == want
    bodies = [r.how for r in entries.orderBy("seq").collect()]
    literal = next(x for b in bodies if len(b) > 400 and sum((x := b[200:230]).lower() in y.lower() for y in bodies) == 1)
    rows = index.rows_for(literal)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    named = re.search(r"texts.*PartitionFilters: \[(?:isnotnull\(block#\d+L?\), )?(?:block#\d+L? IN \(([\d,]+)\)|\(block#\d+L? = (\d+)\))", plan)
    blocks = [int(x) for x in (named[1] or named[2]).split(",")]
    texts = spark.read.parquet(f"{index.root}/{index.generations()[0]}/texts")
    assert 0 < texts.where(F.col("block").isin(blocks)).count() < entries.count() / 10
    assert index.ask(literal, 1000).collect() == search.ask(entries, literal, 1000).collect()


def test_queries_of_all_kinds(spark, index):
    entries = view(spark, SF, "entries")
    for q in ("", "e", "en", "src1", "Heen", "no such text", "é", "%%%", "heen ", "\n"):
        assert index.ask(q, 25).collect() == search.ask(entries, q, 25).collect(), q
        assert index.ask(q, 25, "bugs").collect() == search.ask(entries, q, 25, "bugs").collect(), q


def test_upserts_and_compaction(spark, tmp_path, monkeypatch):
    rnd, now, index = random.Random(2), {}, SearchIndex(spark, str(tmp_path / "i"))
    monkeypatch.setattr(search_index, "HELD", 50)
    assert index.ask("abc").count() == index.ask("ab").count() == 0 and index.upsert(spark.createDataFrame([], SCHEMA)) is None
    for step in range(4):
        batch = {(rnd.choice(("bugs", "facts")), f"n{rnd.randrange(60)}.toml"): tuple(rnd.choice((None, "", "".join(rnd.choice("abAé") for _ in range(12)))) for _ in range(3)) for _ in range(40)}
        now |= batch
        index.upsert(spark.createDataFrame([(*k, *v) for k, v in batch.items()], SCHEMA).repartition(2))
        if step == 2:
            index.compact()
            assert len(index.generations()) == 1
        plain = spark.createDataFrame([(*k, *v) for k, v in now.items()], SCHEMA)
        assert sorted(map(tuple, index.live().select(*plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        for q in ("aba", "bAéa", "ÉA", "aaaaa"):
            assert index.ask(q, 100).collect() == search.ask(plain, q, 100).collect()


def test_literals_anywhere_in_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "STRETCH", 24)
    monkeypatch.setattr(search_index, "SHARED", 10)
    monkeypatch.setattr(search_index, "SLOTS", 4)
    rnd = random.Random(3)
    rows = [("bugs", f"n{i}", "".join(rnd.choice("abc") for _ in range(rnd.randrange(300))), "", None) for i in range(30)]
    df, index = spark.createDataFrame(rows, SCHEMA), SearchIndex(spark, str(tmp_path / "i"))
    index.upsert(df)
    for _ in range(8):
        text = rnd.choice([r[2] for r in rows if len(r[2]) > 60])
        at = rnd.randrange(len(text) - 40)
        q = text[at : at + rnd.choice((4, 9, 10, 11, 40))]
        assert index.ask(q, 100).collect() == search.ask(df, q, 100).collect() != []


def test_an_unfinished_generation_is_not_read(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.upsert(spark.createDataFrame([("bugs", "a", "one", "two", "three")], SCHEMA))
    (tmp_path / "i" / "g00000001-broken" / "texts").mkdir(parents=True)
    assert len(index.generations()) == 1 and index.ask("thr").count() == 1


def test_many_candidates_are_joined(spark, index, monkeypatch):
    monkeypatch.setattr(search_index, "NAMED", 3)
    assert index.ask("heen", 25).collect() == search.ask(view(spark, SF, "entries"), "heen", 25).collect()


def test_postings_equal_plain_ones(spark):
    rnd = random.Random(5)
    letters = ("ab c", "ab\u00e9\n", "x\u4e2d\U0001f600y", "abcdefghijklmnop")
    texts = ["".join(rnd.choice(a) for _ in range(n)) for a in letters for n in (0, 1, 2, 3, 127, 128, 129, 1021, 1022, 1024, 1025, 1026, 1919, 1920, 1921, 70_000)] + [None]
    rows = [(no, *(rnd.choice(texts) for _ in range(3))) for no in [*range(300), *range(search_index.PIECE - 3, search_index.PIECE + 3), 5 * search_index.PIECE]]
    want = {}
    for no, *fields in rows:
        for text in fields:
            text = (text or "").lower()
            for i in range(0, max(1, len(text) - search_index.SHARED), search_index.STRETCH - search_index.SHARED):
                slot = i // (search_index.STRETCH - search_index.SHARED) % search_index.SLOTS
                for t in search_index.trigrams(text[i : i + search_index.STRETCH]):
                    want.setdefault((t, no // search_index.PIECE), set()).add(no % search_index.PIECE * search_index.SLOTS + slot)
    df = spark.createDataFrame(rows, "no long, what string, why string, how string").coalesce(1)
    got = {}
    for r in search_index._postings(df).collect():
        numbers = search_index.decode(bytes(r.numbers)).tolist()
        assert r.n == len(numbers) and bytes(r.numbers) == search_index.encode(numbers)
        got.setdefault((r.trigram, r.piece), []).extend(numbers)
    assert {k: sorted(set(v)) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_postings_are_made_without_a_step_per_trigram():
    texts = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz ", k=2000)) for i in range(200)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        codes, numbers = search_index._cut(texts, np.arange(200) * search_index.SLOTS)
    finally:
        sys.setprofile(before)
    assert len(codes) > 200_000 and calls < 10_000
