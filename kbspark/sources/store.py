"""Versioned tables: a write never touches what is being read.

Each version is a folder of its own; the newest one with Spark's success mark
is the table. A missing table is empty.

A table of buckets is written in part: its rows lie in buckets by a hash of
their keys, each with versions of its own, and a record of each commit says
which version of which bucket belongs to the table. An upsert writes only the
buckets that its keys fall in; readers see one record, whatever is being written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(folder)]
    return sorted(int(n[1:]) for p, n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    if record := _last_record(spark, f"{root}/{name}"):
        return _buckets(spark, f"{root}/{name}", record, schema)
    found = _versions(spark, f"{root}/{name}")
    return spark.read.schema(schema).parquet(f"{root}/{name}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def write_table(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> int:
    """Write the next version; returns its number."""
    found = _versions(df.sparkSession, f"{root}/{name}")
    version = (found[-1] if found else 0) + 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/{name}/v{version}")
    return version


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _last_record(spark: SparkSession, path: str) -> dict | None:
    """The newest commit's record: commit, buckets, and the folder of each bucket that has one."""
    folder, fs = _files(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = sorted(n for n in names if n.endswith(".json"))
    return json.loads(spark.read.text(f"{path}/_commits/{done[-1]}", wholetext=True).first()[0]) if done else None


def _buckets(spark: SparkSession, path: str, record: dict, schema: str, only: Sequence[int] | None = None) -> DataFrame:
    chosen = [f for b, f in record["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in chosen)) if chosen else spark.createDataFrame([], schema)


def upsert_buckets(batch: DataFrame, root: str, name: str, keys: Sequence[str], schema: str, buckets: int = 256) -> int:
    """Upsert ``batch`` (one row per key; columns it lacks become null) into a table of buckets; returns the
    commit's number. ``buckets`` counts when the table is made: take as many as keep a bucket small against a batch's
    rows. Two writers at a time are told apart: the second to commit fails and leaves the first one's table."""
    spark, path = batch.sparkSession, f"{root}/{name}"
    record = _last_record(spark, path)
    if record is None:
        old = _versions(spark, path)  # a table of whole versions becomes one of buckets
        if old:
            batch = batch.unionByName(read_table(spark, root, name, schema).join(batch.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
    record = record or {"commit": 0, "buckets": buckets, "folders": {}}
    place = F.pmod(F.xxhash64(*keys), F.lit(record["buckets"])).cast("int").alias("bucket")
    touched = sorted(r.bucket for r in batch.select(place).distinct().collect())  # no more than there are buckets
    kept = _buckets(spark, path, record, schema, touched).join(batch.select(*keys), list(keys), "left_anti")
    folder = f"w{uuid.uuid4().hex}"
    names = spark.createDataFrame([], schema).columns
    rows = kept.unionByName(batch.select(*(c for c in names if c in batch.columns)), allowMissingColumns=True).select(*names, place)
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    folders = record["folders"] | {str(b): f"{folder}/bucket={b}" for b in touched}
    after = {"commit": record["commit"] + 1, "buckets": record["buckets"], "folders": folders}
    _publish(spark, path, after)
    return after["commit"]


def _publish(spark: SparkSession, path: str, record: dict) -> None:
    target, fs = _files(spark, f"{path}/_commits/{record['commit']:012d}.json")
    draft, _ = _files(spark, f"{path}/_commits/{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has committed {record['commit']} of {path}")


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Remove bucket folders that none of the last ``keep`` commits names; returns how many. Readers of older commits lose them."""
    path = f"{root}/{name}"
    folder, fs = _files(spark, f"{path}/_commits")
    records = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    named = set()
    for r in records[-keep:]:
        named |= set(json.loads(spark.read.text(f"{path}/_commits/{r}", wholetext=True).first()[0])["folders"].values())
    gone = 0
    for w in fs.listStatus(_files(spark, path)[0]):
        top = w.getPath().getName()
        if top[:1] != "w" or not w.isDirectory():
            continue
        for b in fs.listStatus(w.getPath()):
            if b.isDirectory() and f"{top}/{b.getPath().getName()}" not in named:
                fs.delete(b.getPath(), True)
                gone += 1
    for r in records[:-keep]:
        fs.delete(_files(spark, f"{path}/_commits/{r}")[0], False)
    return gone
