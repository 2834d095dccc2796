import hashlib

import numpy as np
import pytest

from kbspark.llm import common, suffix_dedup
from kbspark.llm.queries import op2_suffix_array_dedup


def brute_hits(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                hit[i : i + length] = b"\1" * length
            else:
                seen.add(b[i : i + length])
        out[d] = (b, hit)
    return out


def kept(b, hit):
    return bytes(x for x, h in zip(b, hit) if not h)


def brute(docs, length):
    return {d: (len(b), sum(hit), sum(map(bool, bytes(hit).split(b"\0"))), hashlib.sha256(kept(b, hit)).hexdigest()) for d, (b, hit) in brute_hits(docs, length).items()}


def test_query_equals_brute_force(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in op2_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(texts.items(), 100)


@pytest.mark.parametrize("length, alphabet", [(40, "ab"), (33, "abcdefgh é"), (64, "a")])
def test_built_texts(spark, rnd, length, alphabet):
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 150))) for _ in range(12)]
    docs = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for i in range(60)] + [(90, None), (91, parts[0] * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.cut_repeats(df, length).collect()}
    assert got == brute(docs, length)


@pytest.mark.parametrize("settings", [{"HOT_PIECES": 1}, {"HOT_PIECES": 3, "HOT_BROADCAST": 0}, {"HOT_LEAST": 1, "OFTEN_SAMPLE": 1}, {"HOT_LEAST": 1, "OFTEN_SAMPLE": 1, "HOT_BROADCAST": 0, "SEEN": 5}, {"SEEN": 5, "BATCH_BYTES": 2000, "PART_BYTES": 5000}])
def test_frequent_anchors_and_bounded_state(spark, monkeypatch, texts, settings):
    for name, value in settings.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(common, "HOT_LEAST", 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.cut_repeats(df, 100).collect()}
    assert got == brute(texts.items(), 100)


@pytest.mark.parametrize("length", [8, 9, 16, 20, 33, 40, 100])
def test_family(rnd, length):
    family, seen = suffix_dedup.IndexFamily(length), set()
    for _ in range(8):
        base = bytes(rnd.choice(b"ab") for _ in range(150))
        x = b"".join(base[rnd.randrange(30) :] for _ in range(3))
        windows = np.array(sorted(rnd.sample(range(len(x) - length + 1), 60)))
        for w, hit in zip(windows, family.add(np.frombuffer(x, np.uint8), windows)):
            assert hit == (x[w : w + length] in seen)
            seen.add(x[w : w + length])
    assert len(family.levels) <= 4


def test_anchors_over_chunks(rnd):
    text = bytes(rnd.choice(b"abcd ") for _ in range(5000))
    roll = suffix_dedup.Roller(32)
    for x, y in zip(suffix_dedup.anchors(text, 100, roll), suffix_dedup.anchors(text, 100, roll, chunk=700)):
        assert x.tolist() == y.tolist()


def test_odd(odd, empty):
    rows = suffix_dedup.cut_repeats(odd, 100).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and got[1].n_bytes == 0 and got[2].n_removed == 0 and got[None].n_removed == 0
    assert got[6].n_removed == 42000 - 14  # whatever starts after the first period has started before
    assert suffix_dedup.cut_repeats(empty).count() == 0
    kept = suffix_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and {r.doc_id: r.text for r in kept.collect()}[1] is None


def test_ids_with_several_texts(spark, rnd):
    long = "".join(rnd.choice("abcdefgh") for _ in range(400))
    rows = [(1, long), (1, "x" + long), (2, long), (2, long)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[2:] == [(2, 400), (2, 400)] and sum(n for _, n in got[:2]) == 400


def test_repeated_rows_over_batches(spark, monkeypatch, texts):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 300)
    once = list(texts.items())
    df = spark.createDataFrame([x for x in once for _ in range(2)], "doc_id long, text string").repartition(5)
    rows = suffix_dedup.cut_repeats(df, 100).collect()
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert len(rows) == 2 * len(once) and got == {(d, *x) for d, x in brute(once, 100).items()}
