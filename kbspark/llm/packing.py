"""Best-fit-decreasing packing of token sequences into fixed-length sequences.

Best fit decreasing looks only at lengths, and there are at most ``capacity``
of them. So the documents are counted by length (a bounded table, however many
there are), the packing is played on the counts with a segment tree over the
remaining capacities of open bins, and the outcome is a plan of runs "pieces a
to b of length n go to bins from c on, at offset d". Pieces find their run by
their rank among the pieces of their length, and that in parallel: ranks are
counted per salt, so that one frequent length is many groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import tokens
from kbspark.llm.common import batch_of, stored

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"


class OpenBins:
    """Bins by remaining capacity, as runs of equal bins, with a segment tree
    that finds the tightest capacity that still holds a given length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _add(self, remaining: int, n: int) -> None:
        at = remaining + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def put(self, remaining: int, first: int, n: int) -> None:
        if remaining:
            self.runs[remaining].append((first, n))
            self._add(remaining, n)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that some bin has."""
        at = length + self.leaves
        while not self.tree[at]:
            while at & 1:
                at >>= 1
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return None
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of one run with this capacity: (first bin, how many)."""
        first, n = self.runs[remaining].pop()
        if n > most:
            self.runs[remaining].append((first + most, n - most))
            n = most
        self._add(remaining, -n)
        return first, n


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, from_rank, to_rank, first_bin, offset) of best fit decreasing.

    >>> best_fit_plan({5: 2, 3: 3}, 8)
    [(5, 0, 2, 0, 0), (3, 0, 2, 0, 5), (3, 2, 3, 2, 0)]
    """
    bins, opened, runs = OpenBins(capacity), 0, []
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            space = capacity if room is None else room
            each = min(space // length, left)  # a bin stays the tightest until it is full, so it is filled before the next
            if room is None:
                first, n = opened, left // each
                opened += n
            else:
                first, n = bins.take(room, left // each)
            for k in range(each):
                runs.append((length, rank, rank + n, first, capacity - space + k * length))
                rank += n
            bins.put(space - each * length, first, n)
            left -= each * n
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts, append ``end_id``, cut what is longer than ``capacity``.

    A row per piece: doc_id, piece, start, length, ids (packed, unsigned 16-bit
    if the vocabulary allows, else 32-bit), ids_crc32 (of the ids as unsigned
    32-bit little-endian numbers).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.load(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, packed in zip(batch.column(0)[i : i + 512].to_pylist(), enc.encode(batch.column(1)[i : i + 512].to_pylist())):
                    ids = np.frombuffer(packed + end, enc.dtype)
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at : at + capacity]
                        rows.append((doc_id, k, at, len(piece), piece.tobytes(), zlib.crc32(piece.astype("<u4").tobytes())))
                yield batch_of(rows, PIECES_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """Add sequence_id and offset to stored ``pieces`` (doc_id, piece, length, ...).

    Pieces of the full capacity need no partner and get sequences of their own
    without a rank. Those of one length are ranked in ``salts`` groups, 32 or, of
    very many pieces, up to 512. Gathered: one count per length; broadcast: one per
    length and salt (at most capacity * salts rows) and the plan, whose size
    depends on the lengths alone.
    """
    if salts is None:
        salts = min(512, max(32, pieces.count() // 5_000_000))
    spark = pieces.sparkSession
    full = F.col("length") == capacity
    rest = pieces.where(~full).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = stored(rest.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than capacity rows
    runs = best_fit_plan(counts, capacity) or [(0, 0, 0, 0, 0)]
    plan = spark.createDataFrame(runs, "length long, from_rank long, to_rank long, first_bin long, offset long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rest.withColumn("rank", rank).join(F.broadcast(base), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "salt")
    inside = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["from_rank"]) & (ranked["rank"] < plan["to_rank"])
    packed = ranked.join(F.broadcast(plan), inside).select(
        *(ranked[c] for c in pieces.columns), (plan["first_bin"] + ranked["rank"] - plan["from_rank"]).alias("sequence_id"), plan["offset"]
    )
    alone = pieces.where(full).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; null ids and repeated rows are
    packed as any other; an empty table gives no rows; further columns are left
    out. Offsets in a sequence run without gaps from 0.
    """
    return pack_pieces(stored(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)
