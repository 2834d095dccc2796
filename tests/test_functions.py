import hashlib

import pytest
from pyspark.sql import functions as F

from kbspark.functions import replies, rules, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "said, slug",
    [
        ("Keep Totals in Cents", "keep-totals-in-cents"), ("Paging [by cursor]!", "paging-by-cursor"), ("left __ right ... end", "left-right-end"), ("", ""),
        ("a" * 60, "a" * 50), ("one two three four five six seven eight nine ten eleven", "one-two-three-four-five-six-seven-eight-nine-ten"), ("Café ñandú", "café-ñandú"), (None, None),
    ],
)
def test_slugify(spark, said, slug):
    assert one(spark, said, text.slugify) == slug


@pytest.mark.parametrize("path, ext", [("a/b.md", "md"), ("a/.md", ""), ("a.b/c", ""), ("x.tar.gz", "gz")])
def test_extension(spark, path, ext):
    assert one(spark, "/" + path, text.extension) == ext


def test_small_texts(spark):
    assert one(spark, "a. b .. c.", text.sentences) == ["a", "b", "c"]
    assert one(spark, "a\r\nb\n", text.lines) == ["a", "b"]
    assert one(spark, "  x\t\n", text.trim_space) == "x"
    assert one(spark, "sum\r\nbody", text.summary) == "sum"
    assert one(spark, "x", lambda c: text.author(F.lit(None), F.lit(None))) == "Unknown <unknown@example.com>"
    assert one(spark, "d/f.toml", text.parent_dir) == "d" and one(spark, "f", text.parent_dir) == "unknown"


def test_binary(spark):
    rows = spark.createDataFrame([(bytearray(b"ab\0"),), (bytearray(b"a" * 512 + b"\0"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in rows.select(text.looks_binary(F.col("c"))).collect()] == [True, False, False]


@pytest.mark.parametrize(
    "entry, category",
    [
        (("Orders move to UUIDs", "ids ran out", "an upgrade in two steps"), "migrations"), (("Totals were off by a cent", "a bug in rounding", "h"), "bugs"), (("Dates are kept in UTC", "we chose one zone", "h"), "decisions"),
        (("Uploads end at 20 MB", "the proxy says so", "split them"), "facts"), (("prefix", "y", "h"), "bugs"), (("dispatch", "y", "h"), "bugs"),
    ],
)
def test_infer_category(spark, entry, category):
    row = spark.createDataFrame([entry], "what string, why string, how string")
    assert row.select(rules.infer_category(F.col("what"), F.col("why"), F.col("how"))).first()[0] == category


@pytest.mark.parametrize("summary, kind", [("Patch the rounding of totals", "bug"), ("Migrate carts to UUIDs", "migration"), ("Split the order service", "decision")])
def test_commit_category(spark, summary, kind):
    assert one(spark, summary, rules.infer_commit_category) == kind


def test_replies(spark):
    assert [one(spark, s, replies.retry_after) for s in ("Retry-After: 7", "please retry after 31 s", "x")] == [7, 31, None]
    assert [one(spark, s, replies.error_class) for s in ("HTTP 429", "401", "503 now", "?")] == ["rate_limit", "auth", "unavailable", "request_failed"]
    assert one(spark, '{"agent_message": "hi"}', replies.agent_message) == "hi"
    assert one(spark, "no json", replies.agent_message) is None
    assert len(one(spark, "x" * 300, replies.snippet)) == 200


def test_sha256(spark):
    assert one(spark, "totals", lambda c: F.sha2(c, 256)) == hashlib.sha256(b"totals").hexdigest()
