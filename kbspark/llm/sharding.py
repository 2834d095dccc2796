"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``2**ring_bits`` positions. A
row goes to the owner of the first point at or after its own position; rows
that find the shard full go on clockwise to the next point whose shard has
room. With capacities that add up to the number of rows, all shards end full
and their counts are at most one apart.

Only DataFrame functions touch the rows. What is gathered is one count per
point of the ring (``shards * vnodes`` numbers, whatever the input); from those
the walk around the ring is planned as runs "ranks a to b of arc c go to shard
s", and each row finds its run by its rank within its arc: the rows of the
arc's positions before its own, and its rank among those of its position. So
ranking is dealt to ``2**ring_bits`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import stored


def ring_points(spark, shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order; a fixed, small number."""
    shard = F.floor(F.col("id") / vnodes)  # a node's place depends on its shard and number alone, not on how many shards there are
    node = spark.range(shards * vnodes).select(
        shard.cast("int").alias("shard"), F.shiftrightunsigned(F.xxhash64(shard, F.col("id") % vnodes, F.lit("ring")), 64 - ring_bits).alias("position")
    )
    return sorted((r.position, r.shard) for r in node.collect())


def bounded_walk(points: list[tuple[int, int]], counts: dict[int, int], capacity: list[int]):
    """Runs (arc, from_rank, to_rank, shard, first_slot) of the walk around the ring.

    >>> bounded_walk([(0, 0), (5, 1)], {0: 3, 1: 1}, [2, 2])
    [(0, 0, 2, 0, 0), (0, 2, 3, 1, 0), (1, 0, 1, 1, 1)]
    """
    room, used, runs = list(capacity), [0] * len(capacity), []
    for arc in range(len(points)):
        left, rank, at = counts.get(arc, 0), 0, arc
        while left:
            shard = points[at % len(points)][1]
            if take := min(left, room[shard]):
                runs.append((arc, rank, rank + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank += take
                left -= take
            at += 1
    return runs


def _values(spark, rows, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({names})")


def assign_shards(docs: DataFrame, shards: int = 24, vnodes: int = 64, ring_bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, law ``rows``, shard, slot, grown_shard.

    A null text has size 8 and the checksum of no bytes; a null id is placed by
    its text; repeated rows are placed each on its own, in any order among
    themselves; an empty table gives no rows; other columns are left out.
    ``grown_shard`` is null: under bounded loads a further shard can move rows
    between the old ones.
    """
    spark = docs.sparkSession
    points = ring_points(spark, shards, vnodes, ring_bits)
    ends = [p for p, _ in points]
    # arc i holds the positions after point i-1 up to point i; those after the last point wrap to arc 0
    spans = [(i, (ends[i - 1] + 1) if i else 0, e) for i, e in enumerate(ends)] + [(0, ends[-1] + 1, (1 << ring_bits) - 1)]
    cells = _values(spark, [s for s in spans if s[1] <= s[2]], "arc, lo, hi").select("arc", F.explode(F.sequence("lo", "hi")).alias("cell"))  # 2**ring_bits rows
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    h = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("h", h).withColumn("cell", F.shiftrightunsigned("h", 64 - ring_bits).cast("int"))
    counted = stored(rows.groupBy("cell").agg(F.count("*").alias("n")).join(F.broadcast(cells), "cell"), "cells")  # at most 2**ring_bits rows
    counts = {r["arc"]: r["n"] for r in counted.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # at most shards * vnodes rows
    # arc 0 goes on from the end of the ring to its beginning, any order of its cells will do
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    places = F.broadcast(counted.select("cell", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    n = sum(counts.values())
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    runs = bounded_walk(points, counts, capacity) or [(0, 0, 0, 0, 0)]
    plan = F.broadcast(_values(spark, runs, "arc, from_rank, to_rank, shard, first_slot"))  # at most shards * (vnodes + 1) rows
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank).join(places, "cell").withColumn("rank", F.col("rank") + F.col("before")).alias("r")
    return ranked.join(plan.alias("p"), (F.col("r.arc") == F.col("p.arc")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first_slot") + F.col("rank") - F.col("from_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
