import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "é" * 300 + " the cat sat on the mat"), (6, "a b c d e f g " * 3000), (None, "a text without an id is here"), (7, "12 34 ###"), (8, "One two three four five six seven.")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, and columns whose names clash with the operators' own."""
    rows = [(d, t, "x", 1, "y", 2, b"z") for d, t in ODD]
    names = "doc_id long, text string, rank string, size int, lang string, n int, kept binary"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture
def rnd():
    return random.Random(7)
