"""The stages of the pipeline against brute force, and on odd rows."""

import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from kbspark.llm import decontaminate, langid
from kbspark.llm.common import stored
from tests.llm import test_decontaminate, test_near, test_suffix, test_tokens

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's input, and last the pipeline's result."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        docs = stored(stage(spark, docs, SF), name)
    return out | {"end": docs}


def test_columns(steps):
    columns = steps["language_id"].columns
    assert all(df.columns == columns for name, df in steps.items() if name != "end")
    assert all(r.n_chars == len(r.text) for r in steps["packed_sequences"].collect())


def test_language_id(steps):
    docs = steps["language_id"]
    model = langid.fit_on_documents(docs)
    want = {d: t for d, t in texts_of(docs).items() if not model.predict([t.encode()])[0][2]}
    assert texts_of(steps["near_duplicates"]) == want and len(want) > 0.9 * docs.count()


def test_near_duplicates(steps):
    before = texts_of(steps["near_duplicates"])
    groups = test_near.brute(before.items(), 5, 80, 100)
    assert texts_of(steps["repeated_passages"]) == {d: t for d, t in before.items() if {d} == {c for _, c in groups[d]}}


def test_repeated_passages(steps):
    want = {}
    for d, (b, hit) in test_suffix.brute_hits(texts_of(steps["repeated_passages"]).items(), 100).items():
        text = test_suffix.kept(b, hit).decode("utf-8", "ignore")
        if text.strip() or not any(hit):
            want[d] = text
    assert texts_of(steps["benchmark_passages"]) == want


def test_benchmark_passages(spark, steps):
    before = texts_of(steps["benchmark_passages"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, *_, bad in test_decontaminate.brute(before.items(), items, 13) if bad}
    after = texts_of(steps["packed_sequences"])
    assert set(after) == set(before) - gone and gone
    assert all(after[d] == before[d] for d in after if len(before[d].split()) < 1000)  # shorter ones can't have 50 of 1000 words and stay


def test_long_passages_are_cut(spark):
    item = " ".join(f"q{i}" for i in range(60))
    text = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, f"{text} {item}. {text}"), (2, f"{text} {item[:150]}"), (3, f"{item} end")], "doc_id long, text string")
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    got = texts_of(decontaminate.decontaminate(docs, items, window=13, coverage=(1, 20), max_span=50))
    assert got == {1: f"{text} . {text}", 2: f"{text} {item[:150]}"}


def test_packed_sequences(steps):
    rows, before = steps["end"].collect(), texts_of(steps["packed_sequences"])
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t in before.items():
        ids = [*test_tokens.ids_of(t), 0]
        assert sorted(pieces[d]) == [(k, a, len(ids[a : a + 2048]), test_tokens.crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert set(pieces) == set(before)
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.fixture(scope="module")
def odd_documents(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, "a text without an id is here", None, None, None), (-1, None, "en", "x", 0), (-2, "", "en", "x", 0), (-3, " \n", None, "x", 2), (-4, "one", "xx", None, None), (-4, "one", "xx", None, None), (-5, "so " * 60000, "en", "x", None)]
    return stored(plain.limit(50).unionByName(spark.createDataFrame(rows, plain.schema)).selectExpr("*", "1 AS n", "'a' AS rank", "true AS hot"), "odd")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty(spark, odd_documents, name):
    got = stored(STAGES[name](spark, odd_documents, SF), "got")
    ids = {r.doc_id for r in got.collect()}
    if name != "packed_sequences":
        assert got.columns == odd_documents.columns
    if name == "language_id":
        assert not {-1, -2, -3} & ids
    else:
        assert {-1, -2, -3, -4, None} <= ids and (name != "packed_sequences" or got.where("doc_id = -1").count() == 1)
    assert STAGES[name](spark, odd_documents.where("false"), SF).count() == 0


def test_whole_run(spark, steps):
    got = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, steps["end"].collect()))
    assert all(zlib.crc32(b"") != r.ids_crc32 for r in got)
