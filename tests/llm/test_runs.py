"""Periodic runs against a brute-force search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kbspark.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every maximal stretch of each period, of which those that have a smaller period go."""
    n, found = len(words), {}
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words] or [0])
    for p in range(1, n // 2 + 1):
        same = np.concatenate(([0], (x[p:] == x[:-p]).astype(np.int8), [0]))
        turns = np.flatnonzero(np.diff(same))
        for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if e + p - s >= max(least, 2 * p):
                found.setdefault((s, e + p), p)
    return sorted((s, p, e - s) for (s, e), p in found.items())


def collapsed(words, found):
    gone = {i for s, p, n in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rnd):
    kind, words = rnd.random(), []
    while len(words) < rnd.choice((0, 5, 30, 200, 700)):
        root = [rnd.choice("abc"[: rnd.choice((1, 2, 3))]) if kind < 0.7 else str(rnd.random()) for _ in range(rnd.choice((1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 40, 100)))]
        n = rnd.choice((1, len(root), 2 * len(root), int(2.7 * len(root)), 6 * len(root)))
        words += (root * 7)[:n]
    return words


@pytest.mark.parametrize("long_words", [1 << 14, 40])
def test_random_texts(spark, rnd, long_words):
    texts = [random_text(rnd) for _ in range(400)]
    docs = spark.createDataFrame([(i, " \n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = runs.find_runs(docs, long_words=long_words).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == collapsed(texts[r.doc_id], want)


def test_z_function(rnd):
    for _ in range(300):
        x = [rnd.randrange(2) for _ in range(rnd.randrange(20))]
        common = lambda i: next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i)
        assert runs.z_function(x, len(x)) == [common(i) for i in range(len(x))]


def test_long_text_is_dealt_to_tasks(spark):
    words = [str(i % 3001) for i in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    scan = runs._scan(docs.selectExpr("1L AS row", "doc_id", "CAST(text AS BINARY) AS text"), 12, 2000, False)
    assert scan.where("ids is not null").count() > 1
    assert [tuple(x) for x in runs.find_runs(docs, long_words=2000).first().runs] == [(0, 3001, 40_000)]


def test_query_equals_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want = brute(words)
        best = min(((-n, s, p) for s, p, n in want), default=None)
        r = got[d]
        assert r.n_runs == len(want)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, p, n in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
    assert sum(r.n_runs for r in got.values()) > 10


def test_odd_rows(spark, odd, empty):
    got = sorted(((r.doc_id or 0, len(r.runs), r.collapsed) for r in runs.find_runs(odd).collect()))
    assert len(got) == odd.count() and got.count((4, 0, "one")) == 2
    assert (1, 0, "") in got and (2, 0, "") in got and (3, 0, "") in got and (6, 1, "a b c d e f g") in got
    assert runs.find_runs(empty).count() == 0
