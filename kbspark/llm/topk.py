"""Exact top-k by inner product in three phases, with one threshold for all lists.

The components of the vectors are cut into a few stretches; a stretch's share of
an inner product is the local score of a row, and the shares add up to its
score. Rows, packed into matrices, are dealt to parts; each part meets the
queries of a group at a time.

1. Each part takes the best local scores of every stretch and query and adds up
   what these rows have in all. The k-th best of all parts is a score that at
   least k rows reach: the cutoff.
2. With the cutoff back at the parts, a row that reaches it has in at least one
   of the m stretches an m-th of it or more. Parts collect such rows only, and
   let go of those that cannot reach it with less than an m-th of the cutoff in
   each stretch that didn't show them.
3. What is left is resolved exactly, and the best k of each part go to their query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import stored

#: Rows and queries of a matrix, and about how many bytes of queries meet a part at a time.
BLOCK, QUERY_BLOCK, GROUP_BYTES = 2048, 512, 1 << 24
#: The largest whole number up to which doubles are exact.
EXACT = 2.0**53
_LONG = (1 << 63) - 1


def packed(rows: DataFrame, scale: float, size: int, id_col: str, vec_col: str) -> DataFrame:
    """block, dim, ids, data: vectors of one length as matrices of whole numbers, floor(scale * x)."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                some = batch.slice(i, size)
                ids, vectors = np.asarray(some.column(0).to_numpy(zero_copy_only=False), np.int64), some.column(1)
                lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                there = vectors.is_valid().to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore", invalid="ignore"):
                    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                ends = np.cumsum(lengths)
                odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
                there &= odd[ends] == odd[ends - lengths]
                out: list[tuple] = []
                for dim in np.unique(lengths[there]).tolist():
                    mine = np.flatnonzero(there & (lengths == dim))
                    m = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                    kind = np.int32 if not m.size or np.abs(m).max() < 2**31 else np.float64
                    out.append((dim, ids[mine].tobytes(), m.astype(kind).tobytes()))
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    some = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return stored(some.mapInArrow(pack, "dim int, ids binary, data binary").withColumn("block", F.monotonically_increasing_id()), "packed")


def _matrix(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    kind = np.int32 if len(data) == 4 * dim * len(numbers) else np.float64
    return numbers, np.frombuffer(data, kind).reshape(len(numbers), dim).astype(np.float64)


def shares(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """The local scores of every query and row in each stretch; a single one, of
    Python's integers as far as a long goes, where doubles aren't exact."""
    dim = q.shape[1]
    if dim and q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * dim * lists >= EXACT:
        whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
        return [np.clip(whole(q) @ whole(x).T, -_LONG, _LONG).astype(np.int64)]
    cuts = np.linspace(0, dim, max(1, min(lists, dim)) + 1).astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts, cuts[1:])]


class Local:
    """The best ``k`` rows of each query of a block that a part has seen."""

    def __init__(self, k: int):
        self.k, self.kept = k, [np.empty(0, np.int64)] * 3

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.kept = [np.concatenate((a, b.astype(np.int64))) for a, b in zip(self.kept, (query, score, row))]
        query, score, row = self.kept
        order = np.lexsort((row, -score, query))
        query = query[order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        self.kept = [c[order][rank < self.k] for c in self.kept]


def _local_lists(parts: list[np.ndarray], q_ids: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query, score, row of those that some list has among its best."""
    n = min(k + 1, len(x_ids))  # the query itself may be among them
    best = np.concatenate([np.argpartition(-p, n - 1, axis=1)[:, :n] if n < len(x_ids) else np.tile(np.arange(n), (len(q_ids), 1)) for p in parts], axis=1)
    best.sort(axis=1)
    fresh = np.concatenate((np.ones((len(best), 1), bool), best[:, 1:] != best[:, :-1]), axis=1) & (x_ids[best] != q_ids[:, None])
    total = sum(np.take_along_axis(p, best, 1) for p in parts)
    query, at = np.nonzero(fresh)
    return query, total[query, at], x_ids[best[query, at]]


def _sufficient(parts: list[np.ndarray], q_ids: np.ndarray, x_ids: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, ...]:
    """query, score, row of those that reach their query's cutoff."""
    m, cut = len(parts), cutoff[:, None].astype(parts[0].dtype)
    shown = [m * p >= cut for p in parts] if m > 1 else [parts[0] >= cut]
    hidden = m - sum(s.astype(np.int8) for s in shown)
    known = sum(np.where(s, p, 0) for s, p in zip(shown, parts))
    query, row = np.nonzero((hidden < m) & (m * known + hidden * cut >= m * cut) if m > 1 else shown[0])
    score = sum(p[query, row] for p in parts)
    kept = (score >= cut[query, 0]) & (q_ids[query] != x_ids[row])
    return query[kept], score[kept], x_ids[row[kept]]


_MEET = "grp int, part int, kind int, dim int, block long, ids binary, data binary, cutoff binary"


def _meet(rows: DataFrame, queries: DataFrame, groups: int, parts: int, k: int, lists: int) -> DataFrame:
    """block, place, score, row: the best of each part for each query, above its cutoff where there is one."""
    deal = lambda n, of: F.pmod(F.xxhash64("block", F.lit(of)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.withColumn("part", deal(parts, "part")).withColumn("grp", all_of(groups)).withColumn("cutoff", F.lit(None).cast("binary")).withColumn("kind", F.lit(1))
    q = queries.withColumn("grp", deal(groups, "group")).withColumn("part", all_of(parts)).withColumn("kind", F.lit(0))
    names = [x.split()[0] for x in _MEET.split(", ")]
    both = q.select(names).unionByName(r.select(names)).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    schema = pa.schema([(c, pa.int64()) for c in ("block", "place", "score", "row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for block, _, _, _, local in held:
                query, score, row = local.kept
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), block, np.int64)), pa.array(query), pa.array(score), pa.array(row)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                grp, part, kind, dim, block, ids, data, cutoff = (c[i].as_py() for c in batch.columns)
                if (grp, part) != at:
                    yield from done()
                    at, held = (grp, part), []
                ids, m = _matrix(dim, ids, data)
                if kind == 0:
                    held.append((block, ids, m, None if cutoff is None else np.frombuffer(cutoff, np.int64), Local(k)))
                    continue
                for _, q_ids, q, cut, local in held:
                    if q.shape[1] == dim:
                        parts_ = shares(q, m, lists)
                        local.add(*(_local_lists(parts_, q_ids, ids, k) if cut is None else _sufficient(parts_, q_ids, ids, cut)))
        yield from done()

    return both.mapInArrow(run, "block long, place long, score long, row long")


def _with_cutoffs(queries: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """``queries`` with the k-th best score of each, or the lowest there is, as ``cutoff``."""
    kth = lists.groupBy("block", "place").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # k scores of each part
    kth = kth.select("block", F.struct("place", F.get("s", F.lit(k - 1)).alias("cut")).alias("c")).groupBy("block").agg(F.collect_list("c").alias("c"))
    schema = pa.schema([("block", pa.int64()), ("cutoff", pa.binary())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cut = np.full(r["n"], -_LONG, np.int64)
                for x in r["c"] or ():
                    if x["cut"] is not None:
                        cut[x["place"]] = x["cut"]
                out.append({"block": r["block"], "cutoff": cut.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema)

    laid = queries.select("block", (F.length("ids") / 8).cast("long").alias("n")).join(kth, "block", "left").mapInArrow(lay, "block long, cutoff binary")
    return queries.join(laid, "block")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, lists: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: for each row of ``queries`` the ``k`` rows of
    ``rows`` with the highest inner products of the vectors floor(scale * x), ties to the
    smaller id; all, if there are fewer.

    A row with the query's own id is none of its candidates. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no
    part; vectors of different lengths don't meet. A repeated row is a candidate,
    or a query, for each time it is there. Scores beyond a long are held at its
    ends. Empty tables give no rows; further columns are left out.
    """
    spark = rows.sparkSession
    n = queries.count()
    asked = packed(queries.select(id_col, vec_col).repartition(max(1, -(-n // QUERY_BLOCK))), scale, QUERY_BLOCK, id_col, vec_col)
    having = packed(rows, scale, BLOCK, id_col, vec_col)
    size = asked.agg(F.sum(F.length("data"))).first()[0] or 0
    parts, groups = int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // GROUP_BYTES
    lists_ = _meet(having, asked.withColumn("cutoff", F.lit(None).cast("binary")), groups, parts, k, lists)
    best = _meet(having, stored(_with_cutoffs(asked, lists_, k), "cutoffs"), groups, parts, k, lists)
    names = asked.select("block", F.col("ids")).mapInArrow(_query_ids, "block long, place long, query_id long")
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "row"))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(names, ["block", "place"]).select("query_id", "rank", F.col("row").alias("id"), "score")


def _query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(*(c.to_pylist() for c in batch.columns)):
            numbers = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), block, np.int64)), pa.array(np.arange(len(numbers))), pa.array(numbers)], names=["block", "place", "query_id"])
