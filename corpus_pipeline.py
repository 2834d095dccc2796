"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns
of ``documents``; the last returns packed pieces. ``run`` writes each stage's
result as Parquet in the shared folder and gives it to the next.

Every stage takes null texts, ids and languages, empty and very long texts,
repeated rows, further columns and an empty table. What happens to texts that
it can't judge is said with it; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontaminate, langid, ngram_join, packing, suffix_dedup
from kbspark.llm.common import stored, table
from kbspark.llm.queries import WORD_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them), or too far from every language that they teach, go."""
    return langid.keep_identified(docs, langid.fit_on_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the smallest id stays;
    so do texts without words, rows without an id, and all rows of an id that stays."""
    return ngram_join.keep_one_of_each(docs, k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that have occurred earlier are cut out of the texts. Null and
    shorter texts and rows without an id stay as they are; documents of which only
    white space is left go. A repeated row loses what its first one loses."""
    return suffix_dedup.drop_repeats(docs, length=100).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which test items' passages are a twentieth or more go; from others,
    passages of more than 50 words are cut. Texts without words stay."""
    kept = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, coverage=(1, 20), max_span=50)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens; a null or empty text is the end id alone."""
    return packing.pack_documents(docs, WORD_BPE, end_id=0, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]

#: Similarity groups, suffix arrays and tokenizing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
