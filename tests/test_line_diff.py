"""Line diffs against a table of longest common subsequences, and rules from tables."""

import random

import pytest
from pyspark.sql import functions as F

from kbspark.functions import rules
from kbspark.operators import commits, line_diff


def brute(a, b):
    a, b = line_diff.lines_of(a), line_diff.lines_of(b)
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return len(b) - row[-1], len(a) - row[-1]


@pytest.mark.parametrize("kinds", [2, 5, 300])
def test_random_texts(kinds):
    rnd = random.Random(kinds)
    for _ in range(150):
        a = [b"%d\n" % rnd.randrange(kinds) for _ in range(rnd.randrange(60))]
        b = [x for x in a if rnd.random() < 0.8] if rnd.random() < 0.5 else [b"%d\n" % rnd.randrange(kinds) for _ in range(rnd.randrange(60))]
        for at in range(rnd.randrange(4)):
            b.insert(rnd.randrange(len(b) + 1), b"new %d\n" % at)
        x, y = b"".join(a), b"".join(b)[: -1 if rnd.random() < 0.3 and b else None]
        assert line_diff.changed_lines(x, y) == brute(x, y)


def test_both_ways_agree():
    rnd = random.Random(4)
    for n in (1, 10, 400):
        a, b = ([rnd.randrange(n) for _ in range(n)] for _ in range(2))
        d = line_diff._greedy(a, b, 2 * n)
        assert (len(a) + len(b) - d) // 2 == line_diff._common(a, b)
        assert line_diff._greedy(a, [x + n for x in b], n) is None


def test_known_cases():
    assert line_diff.changed_lines(b"line1\nline2\nline3", b"line1\nline3\nline4\nline5") == (3, 2)
    assert line_diff.changed_lines(b"line1\nline2\nline3\n", b"line1\nline3\nline4\nline5\n") == (2, 1)
    assert line_diff.changed_lines(None, b"a\nb") == (2, 0) and line_diff.changed_lines(b"a", None) == (0, 1) and line_diff.changed_lines(b"", b"") == (0, 0)


def test_long_files_that_differ_everywhere():
    rnd = random.Random(5)
    lines = [b"%d\n" % i for i in range(30_000)]
    mixed = lines[:]
    rnd.shuffle(mixed)
    plus, minus = line_diff.changed_lines(b"".join(lines), b"".join(mixed))
    tails = []  # a longest common subsequence is a longest increasing one here
    import bisect

    for x in (int(m) for m in mixed):
        at = bisect.bisect_left(tails, x)
        tails[at : at + 1] = [x]
    assert plus == minus == 30_000 - len(tails)


def test_content_diffs(spark):
    before = [("same", b"a\n"), ("edit", b"a\nb\n"), ("gone", b"x\ny"), ("bin", b"\0a"), ("null", None), (None, b"q"), ("empty", b"")]
    after = [("same", b"a\n"), ("edit", b"a\nc\n"), ("new", b"1\n2\n"), ("bin", b"\0b"), ("null", b"z"), (None, b"r"), ("empty", b"")]
    frame = lambda rows: spark.createDataFrame(rows, "path string, content binary").withColumn("old", F.lit(1))
    got = {r.path: (r.insertions, r.deletions, r.is_binary) for r in line_diff.content_diffs(frame(before), frame(after)).collect()}
    assert got == {"edit": (1, 1, False), "gone": (0, 2, False), "new": (2, 0, False), "bin": (0, 0, True), "null": (1, 0, False)}
    assert line_diff.content_diffs(frame(before).limit(0), frame(after).limit(0)).count() == 0


def test_rules_of_a_table_equal_those_of_a_mapping(spark, monkeypatch):
    rnd = random.Random(6)
    table = {"".join(rnd.choice("abé/") for _ in range(rnd.choice((1, 2, 3)))): rnd.choice((0.1, 0.5, 0.8)) for _ in range(25)}
    texts = spark.createDataFrame([("".join(rnd.choice("abé/x") for _ in range(rnd.randrange(9))),) for _ in range(200)] + [(None,)], "text string")
    frame = spark.createDataFrame([*table.items(), (None, 1.0), ("ab", None)] + [(t, w / 2) for t, w in table.items()], "token string, weight double")
    for known, rows in ((table, frame), ({}, frame.limit(0))):
        h, t = rules.best_rule(F.col("text"), known)
        h2, t2 = rules.table_rule(rows)(F.col("text"))
        got = texts.select(h.alias("h"), t.alias("t"), h2.alias("h2"), t2.alias("t2")).collect()
        assert all((r.h, r.t) == (r.h2, r.t2) for r in got)
    monkeypatch.setattr(rules, "MOST_CHARS", 3)
    with pytest.raises(ValueError):
        rules.table_rule(frame)


def test_the_plan_does_not_grow_with_the_rules(spark):
    c = spark.createDataFrame([("c", 1, "m", 1)], "hash string, pos long, message string, n_parents int")
    d = spark.createDataFrame([("c", "core/x", 9, 0)], "hash string, path string, insertions long, deletions long")
    few, many = (spark.range(n).select(F.concat(F.lit("core/"), F.col("id") % 7, "id").alias("token"), F.lit(0.5).alias("weight")) for n in (10, 10_000))
    plans = [commits.score_commits(c, d, x, x)._jdf.queryExecution().analyzed().toString() for x in (few, many)]
    assert abs(len(plans[0]) - len(plans[1])) < 100
