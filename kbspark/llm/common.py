"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="kbspark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only where the session leaves it unset and runs in one JVM,
    as in tests; on a cluster a missing setting is an error, since a
    machine-local folder would be lost with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _local_folder()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kbspark/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so a lost executor costs a re-read instead of a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are worth a task.
TASK_ROWS = 1 << 18


def packed(df: DataFrame, rows: int, least: int = 2) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in no more tasks than they are worth, however many partitions exchanges
    have. A large table keeps the partitions that it has. With ``least`` 1, a table that fits one task needs no exchange;
    only for what meets nothing but itself, as a join would draw its other side, however large, into that task."""
    return df.coalesce(max(least, -(-rows // TASK_ROWS)))


#: A join key is hot if it has more than a HOT_KEYS-th of all rows, so that no more than HOT_KEYS keys are.
HOT_KEYS, HOT_LEAST = 4096, 1024


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame | None:
    """The keys of ``rows`` (a stored table) with very many rows, and into how many
    parts to deal them; None if there are none."""
    n = rows.count()
    limit = max(HOT_LEAST, n // HOT_KEYS)
    if n <= limit:
        return None
    often = packed(rows, n, 1).groupBy(on).agg(F.count("*").alias("n"))
    often = packed(often, n, 1).where(F.col("n") > limit)
    hot = stored(often.select(*on, F.ceil(F.col("n") / limit).cast("int").alias("__parts")), "hot")
    return None if hot.isEmpty() else hot


def spread_join(rows: DataFrame, other: DataFrame, on: list[str], hot: DataFrame | None, by: str) -> DataFrame:
    """``rows`` joined with ``other``, which has few rows per key: rows of ``hot`` keys
    are dealt to parts by a hash of column ``by``, and their partners copied to each."""
    if hot is None:
        return rows.join(other, on)
    mark = F.broadcast(hot)  # HOT_KEYS rows at most
    left = rows.join(mark, on, "left").withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("__parts"))).otherwise(0).cast("int")).drop("__parts")
    right = other.join(mark, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*on, "__part"]).drop("__part")


#: Most bits of the filter that ``among`` broadcasts, and cells of 64 bits that are one row of it.
FILTER_BITS, FILTER_CELLS = 1 << 26, 64


def filter_rows(ids: DataFrame, of: str, bits: int) -> DataFrame:
    """__block, __cells: a row of cells of 64 bits for each stretch of a filter of the numbers ``of``."""
    at = F.pmod(F.xxhash64(of), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({of}), {bits}) % 64 AS INT))")
    marks = ids.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(bit).alias("marks"))
    found = F.map_from_entries(F.collect_list(F.struct((F.col("cell") % FILTER_CELLS).cast("int"), "marks")))  # FILTER_CELLS at most
    rows = marks.groupBy(F.expr(f"cell div {FILTER_CELLS}").alias("__block")).agg(found.alias("found"))
    return rows.select("__block", F.transform(F.sequence(F.lit(0), F.lit(FILTER_CELLS - 1)), lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("long"))).alias("__cells"))


def among(rows: DataFrame, by: str, ids: DataFrame, of: str, most: int | None = None) -> DataFrame:
    """The rows whose number ``by`` is among the numbers ``of`` of ``ids`` (a stored table), and few others: a filter
    of 64 bits for each, FILTER_BITS (8 MB) at most, keeps the rest out of what follows. Beyond some ten million
    numbers it keeps out less, and in the end nothing. ``rows`` that are no more than a task's (``most``) pass as they are."""
    if most is not None and most <= TASK_ROWS:
        return rows
    n = ids.count()
    bits = min(FILTER_BITS, max(64 * FILTER_CELLS, 1 << (64 * n).bit_length()))
    at = F.pmod(F.xxhash64(by), F.lit(bits))
    block = F.shiftright(at, (64 * FILTER_CELLS).bit_length() - 1)
    found = F.get("__cells", (F.shiftright(at, 6) % FILTER_CELLS).cast("int")).bitwiseAND(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({by}), {bits}) % 64 AS INT))"))
    return rows.withColumn("__block", block).join(F.broadcast(filter_rows(packed(ids, n, 1), of, bits)), "__block").where(found != 0).drop("__block", "__cells")


def utf8(column: str):
    """A text column as UTF-8 bytes."""
    return F.col(column).cast("binary")


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def batch_of(rows: Sequence[tuple], schema: str) -> pa.RecordBatch:
    """An Arrow batch of row tuples; ``schema`` as in "doc_id long, ids binary"."""
    named = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


_STATE: dict[str, object] = {}


def worker_state(owner: str, make=dict):
    """What a Python worker keeps between its tasks, for one owner at a time: a
    worker that goes on to another operator first lets go of the last one's."""
    if owner not in _STATE:
        _STATE.clear()
        _STATE[owner] = make()
    return _STATE[owner]
