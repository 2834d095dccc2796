import hashlib
import random
import re

import pytest

from kbspark.llm import decontaminate as dc
from kbspark.llm.queries import op3_benchmark_decontamination

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window):
    words = lambda t: WORDS.findall(t.encode().lower()) if t else []
    found = {}
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(k)
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if of := found.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= of
        names = sorted(str(x) for x in names if x is not None)
        yield d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("seed", range(100))
def test_automaton(seed):
    rnd = random.Random(seed)
    window, letters = rnd.randint(1, 5), "abc"[: rnd.randint(1, 3)]
    text = lambda: " ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12)))
    items, docs = [(rnd.randint(0, 3), text()) for _ in range(4)], [(i, f"{text()} {text()}") for i in range(5)]
    machine = dc.ItemAutomaton([(str(k), dc.words_of(t.encode())) for k, t in items], window)
    for (_, _, n_hit, n_items, sha, _), (_, t) in zip(brute(docs, items, window), docs):
        spans, names = machine.match(dc.words_of(t.encode()))
        assert (sum(b - a for a, b in spans), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()) == (n_hit, n_items, sha)


def test_query(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = sorted(map(tuple, op3_benchmark_decontamination(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(brute(texts.items(), items, 13))


def test_ids_with_commas_over_blocks(spark):
    items = spark.createDataFrame([("a,b", "the cat sat on the mat today"), ("c", "a dog ran over the green hill"), ("c", "the cat sat on the mat today"), ("ä", "one two three four five")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "so the cat sat on the mat today and a dog ran over the green hill"), (2, "nothing of them"), (3, "ONE two three four five")], "doc_id long, text string")
    for size in (1 << 20, 30):
        got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in dc.contamination(docs, items, window=5, block_bytes=size).collect()}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got == {1: (14, 2, sha("a,b,c")), 2: (0, 0, sha("")), 3: (5, 1, sha("ä"))}


@pytest.mark.parametrize("seed", range(30))
def test_filter_loses_no_window(seed):
    rnd = random.Random(seed)
    texts = [[rnd.choice(b"abcdefghijklm".split() + [b"x", b"y", b"z"]) for _ in range(rnd.randint(0, 9))] for _ in range(20)]
    seen = dc.WindowFilter(4, 1000)
    for w in texts:
        seen.add(w)
    assert all(seen.may_hold([b"q", *w, b"q"]) for w in texts if w)
    assert not seen.may_hold([b"q"] * 20)


def test_blocks_and_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (None, "a b c d"), (1, "one"), (10, "ONE")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(brute(docs, [tuple(r) for r in items.collect()], 4), key=str)
    for size in (1 << 20, 8):
        got = dc.contamination(odd, items, window=4, block_bytes=size).drop("spans").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert dc.contamination(empty, items).count() == 0
    none = dc.contamination(odd, items.where("false")).collect()
    assert len(none) == odd.count() and not any(r.contaminated for r in none)
    cut = dc.decontaminate(odd, items, window=4, coverage=(2, 1), max_span=1)
    assert cut.columns == odd.columns and {r.doc_id: r.text for r in cut.collect()}[5] == "é" * 300 + " "
    assert {r.doc_id for r in dc.decontaminate(odd, items, window=4).collect()} == {1, 2, 3, 7, None}  # 8 has the item "ONE"
