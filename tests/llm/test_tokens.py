import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kbspark.llm import packing, records, tokens
from kbspark.llm.queries import WORD_BPE, op4_token_records, op8_best_fit_packing

SF = "/root/testdata/sf0.001"
PLAIN = Tokenizer.from_file(WORD_BPE)
CHUNKED = tokens.ChunkTokenizer(WORD_BPE, cache_chunks=50)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aB'se.,é 1\n\t\u0301İΣ<|>endoftx\x1f\u2003", max_size=40)), max_size=4))
def test_chunks_are_the_whole(texts):
    got = CHUNKED.encode(texts)
    assert [np.frombuffer(x, CHUNKED.dtype).tolist() for x in got] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("text", ["İ.", "aİ, b", "\u0958.", "e\u0301. é.", "Σς. ß, ŉ.", "1. a1. _. a_, b", "don't. ''s."])
def test_letters_before_stops(text):
    assert np.frombuffer(CHUNKED.encode([text])[0], CHUNKED.dtype).tolist() == ids_of(text)


def test_special_tokens_and_nulls():
    assert [np.frombuffer(x, CHUNKED.dtype).tolist() for x in CHUNKED.encode([None, "", "a <|endoftext|> b"])] == [[], [], ids_of("a <|endoftext|> b")]


def test_records_query(spark, texts):
    got, at = {r.doc_id: r for r in op4_token_records(spark, SF).collect()}, 0
    for d in sorted(texts):
        ids = [*ids_of(texts[d]), 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(texts)


def test_records_odd(spark, odd, empty):
    index = records.write_records(odd, WORD_BPE)
    rows = records.with_starts(records.read_records(index), index).collect()
    assert len(rows) == odd.count() and min((r for r in rows), key=lambda r: r.start).doc_id is None
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 1
    some = records.read_records(index.where("doc_id IN (5, 8)")).collect()  # a part, in any order
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in some} == {d: [*ids_of(t), 2] for d, t in ((r.doc_id, r.text) for r in odd.collect()) if d in (5, 8)}
    assert records.read_records(records.write_records(empty, WORD_BPE)).count() == 0


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 65535)))
def test_frames(doc_id, ids):
    data = records.frame(doc_id, 2, np.array(ids, "<u2").tobytes())
    back, got = records.unframe(data)
    assert back == doc_id and got.tolist() == ids
    at = random.Random(len(data)).randrange(len(data))
    with pytest.raises(ValueError):
        records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def best_fit(counts, capacity):
    bins = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [i for i, room in enumerate(bins) if room >= n]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= n
            else:
                bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=10))))
def test_plan_is_best_fit_decreasing(case):
    capacity, counts = case
    filled, ranks = {}, {}
    for n, a, b, first, offset in packing.best_fit_plan(counts, capacity):
        assert ranks.get(n, 0) == a
        ranks[n] = b
        for k in range(first, first + b - a):
            assert filled.get(k, 0) == offset
            filled[k] = offset + n
    assert ranks == counts and sorted(capacity - x for x in filled.values()) == best_fit(counts, capacity)


def check_packed(rows, docs, capacity=2048):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    for d, t in docs.items():
        ids, at = [*ids_of(t), 0], 0
        for r in sorted(pieces[d], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length]) and (r.length == capacity or at + r.length == len(ids))
            at += r.length
        assert at == len(ids)
    return len(sequences)


def test_packing_query(spark, texts):
    rows = op8_best_fit_packing(spark, SF).collect()
    assert check_packed(rows, texts) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_odd(odd, empty):
    rows = packing.pack_documents(odd, WORD_BPE, capacity=512).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert next(r for r in rows if r.doc_id == 1).length == 1
    assert packing.pack_documents(empty, WORD_BPE).count() == 0
