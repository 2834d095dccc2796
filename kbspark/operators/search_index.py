"""Literal search through an index of trigrams, kept as tables beside the texts.

Each generation is a folder: ``texts``, numbered rows in folders of consecutive
numbers, so that few folders are read for few rows; ``postings``, for each
trigram the stretches of rows that have it, as numbers that are delta-coded and
cut into pieces, in folders by a hash of the trigram; and ``dead``, the rows of older generations
that its rows replace. An upsert adds a generation and rewrites nothing;
``compact`` brings all of them together in one.

A query is looked up by its rarest trigrams. Their postings are intersected
piece by piece. Stretches overlap by as much of a query as is looked up, so that
it lies in one of them, and even a long text has to have all its trigrams close
together. What is left is verified on the texts by the same operator
that searches without an index, so results are the same. Queries of fewer than
three characters, which have no trigram, read all texts.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import search
from kbspark.shared import stored

KEY = ("category", "file_name")
#: Rows per piece of a posting list, folders of postings, postings that a task holds before it writes them out, trigrams
#: that a query looks up, and folders of texts that it names one by one.
PIECE, BUCKETS, HELD, RAREST, NAMED = 1 << 16, 64, 2_000_000, 16, 10_000
#: Characters of a stretch, of which it shares so many with the next, and how many stretches of a row have numbers of
#: their own (those of a longer text share them).
STRETCH, SHARED, SLOTS = 1024, 128, 64


def encode(numbers: list[int]) -> bytes:
    """Ascending numbers as the differences from one to the next, seven bits a byte, low ones first."""
    out, last = bytearray(), 0
    for n in numbers:
        d, last = n - last, n
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(b):
        return b
    first = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    at = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.cumsum(np.add.reduceat((b & 127) << (7 * at), first))


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


#: Bits of a number within a piece, of a character's place in a trigram's code, and of one that most texts need.
NUMBER_BITS, CHAR_BITS, FEW_BITS = (PIECE * SLOTS - 1).bit_length(), 21, 14
#: Rows whose texts are cut at a time.
ROWS = 256


def _code(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    return a << 2 * bits | b << bits | c


def _chars(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << bits) - 1
    return codes >> 2 * bits, codes >> bits & low, codes & low


def _distinct(codes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of codes and numbers, in order."""
    chars = _chars(codes, CHAR_BITS)
    if len(codes) and max(int(x.max()) for x in chars) >> FEW_BITS - 1:  # a pair needs more than a word
        all_, codes = np.unique(codes, return_inverse=True)
    else:
        all_, codes = None, _code(*chars, FEW_BITS)
    both = np.sort(codes << NUMBER_BITS | numbers)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    codes, numbers = both >> NUMBER_BITS, both & (1 << NUMBER_BITS) - 1
    return (_code(*_chars(codes, FEW_BITS), CHAR_BITS) if all_ is None else all_[codes]), numbers


def _cut(fields: list[str | None], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams' codes of ``fields`` with the numbers of their stretches, each pair once; ``numbers`` are those of
    the fields' first stretches."""
    texts = [f or "" for f in fields]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(chars) < 3:
        return chars[:0], chars[:0]
    own = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(chars)) - (np.cumsum(sizes) - sizes)[own]
    whole = np.flatnonzero(at[:-2] < sizes[own[:-2]] - 2)  # trigrams that end in the same text
    code = _code(chars[whole], chars[whole + 1], chars[whole + 2], CHAR_BITS)
    own, at = own[whole], at[whole]
    step = STRETCH - SHARED
    k = at // step
    last = (np.maximum(1, sizes - SHARED) - 1) // step
    here, before = k <= last[own], (k > 0) & (at - (k - 1) * step < STRETCH - 2)
    number = lambda which, k: numbers[own[which]] + k[which] % SLOTS
    return _distinct(np.concatenate((code[here], code[before])), np.concatenate((number(here, k), number(before, k - 1))))


def encode_lists(numbers: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Ascending numbers, in lists that begin at ``starts``, as the differences from one to the next, seven bits a byte, low ones first."""
    d = np.diff(numbers, prepend=0)
    d[starts] = numbers[starts]
    size = 1 + sum((d >> 7 * i > 0).astype(np.int64) for i in range(1, 5))
    end = np.cumsum(size)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    for i in range(5):
        have = np.flatnonzero(size > i)
        out[end[have] - size[have] + i] = d[have] >> 7 * i & 127 | np.where(size[have] > i + 1, 128, 0)
    offsets = np.append((end - size)[starts], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _postings(texts: DataFrame) -> DataFrame:
    """trigram, piece, n, numbers of ``texts`` (no and the searched fields)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        piece, count = None, 0

        def flush() -> pa.RecordBatch:
            codes, numbers = _distinct(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else codes
            names = ["".join(map(chr, t)) for t in zip(*(x.tolist() for x in _chars(codes[starts], CHAR_BITS)))]
            n = np.diff(np.append(starts, len(codes)))
            columns = [pa.array(names, pa.string()), pa.array(np.full(len(names), piece), pa.int64()), pa.array(n, pa.int64()), encode_lists(numbers, starts)]
            return pa.RecordBatch.from_arrays(columns, names=["trigram", "piece", "n", "numbers"])

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                nos, *fields = (c[i : i + ROWS].to_pylist() for c in batch.columns)
                nos = np.array(nos, np.int64)
                for p in dict.fromkeys((nos // PIECE).tolist()):
                    if piece is not None and held and (p != piece or count > HELD):
                        yield flush()
                        count = 0
                    piece = p
                    mine = np.flatnonzero(nos // PIECE == p).tolist()
                    held.append(_cut([f[j] for f in fields for j in mine], np.tile((nos[mine] - p * PIECE) * SLOTS, len(fields))))
                    count += len(held[-1][0])
        if held:
            yield flush()

    rows = texts.select("no", *(F.lower(f) for f in search.FIELDS)).mapInArrow(run, "trigram string, piece long, n long, numbers binary")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int"))


class SearchIndex:
    """Entries (category, file_name, what, why, how and any other columns) below ``root``, one row per key."""

    def __init__(self, spark: SparkSession, root: str, block_rows: int | None = None):
        """``block_rows``, a power of two, is how many rows of a task share a folder; unless given, it grows with a batch."""
        self.spark, self.root, self.block_rows = spark, root.rstrip("/"), block_rows

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[str]:
        """The folders of complete generations that no compact one has replaced, oldest first."""
        folder, fs = self._hadoop(self.root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n[:1] == "g" and fs.exists(self._hadoop(f"{self.root}/{n}/done/_SUCCESS")[0])]
        whole = [i for i, n in enumerate(names) if "-all-" in n]
        return names[whole[-1] :] if whole else names

    def _read(self, name: str, generations: list[str], empty: str | None = None) -> DataFrame:
        each = [self.spark.read.parquet(f"{self.root}/{g}/{name}").withColumn("generation", F.lit(g)) for g in generations]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each) if each else self.spark.createDataFrame([], empty)

    def _dead(self, generations: list[str]) -> DataFrame:
        each = [self.spark.read.parquet(f"{self.root}/{g}/dead") for g in generations]
        return functools.reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], "of string, no long")

    def live(self, texts: DataFrame | None = None) -> DataFrame:
        """The rows of all generations, or those of ``texts``, that none has replaced."""
        have = self.generations()
        rows = self._read("texts", have, "category string, file_name string, what string, why string, how string, no long, block long, generation string") if texts is None else texts
        return rows.join(self._dead(have).withColumnRenamed("of", "generation").distinct(), ["generation", "no"], "left_anti")

    def _write(self, rows: DataFrame, name: str, replaced: DataFrame | None) -> None:
        path = f"{self.root}/{name}"
        size = self.block_rows or 1 << max(6, min(16, (rows.count() // 4096).bit_length()))  # numbers of a task start at a power of two
        numbered = rows.withColumn("no", F.monotonically_increasing_id())
        numbered.withColumn("block", F.expr(f"no div {size}")).write.partitionBy("block").parquet(f"{path}/texts")
        texts = self.spark.read.parquet(f"{path}/texts")
        postings = _postings(texts).repartition("bucket").sortWithinPartitions("bucket", "trigram")
        postings.write.partitionBy("bucket").parquet(f"{path}/postings")
        if replaced is None:
            replaced = self.spark.createDataFrame([], "of string, no long")
        replaced.write.parquet(f"{path}/dead")
        self.spark.createDataFrame([(size, BUCKETS)], "block_rows long, buckets int").coalesce(1).write.parquet(f"{path}/done")

    def upsert(self, batch: DataFrame) -> str | None:
        """Add ``batch`` (one row per key), which replaces rows of the same keys; returns the new generation's name,
        or that of the last one (None without one) for an empty batch."""
        have = self.generations()
        if not batch.limit(1).count():
            return have[-1] if have else None
        name = f"g{len(have) + self._first(have):08d}-{uuid.uuid4().hex[:8]}"
        replaced = None
        if have:
            keys = self._read("texts", have).select(*KEY, F.col("generation").alias("of"), "no")  # keys alone are read
            replaced = keys.join(batch.select(*KEY).distinct(), list(KEY), "left_semi").select("of", "no")
        self._write(batch, name, replaced)
        return name

    @staticmethod
    def _first(have: list[str]) -> int:
        return int(have[0][1:9]) if have else 0

    def compact(self) -> str:
        """All live rows as one generation, from which reading begins then."""
        have = self.generations()
        name = f"g{len(have) + self._first(have):08d}-all-{uuid.uuid4().hex[:8]}"
        self._write(self.live().drop("generation", "no", "block"), name, None)
        return name

    def candidates(self, query: str) -> DataFrame | None:
        """generation and no of the rows that have the rarest trigrams of ``query``; None if it has no trigram."""
        wanted = sorted(trigrams(query.lower()[:SHARED]))
        if not wanted:
            return None
        have = self.generations()
        none = self.spark.createDataFrame([], "generation string, no long")
        if not have:
            return none
        bucket = self.spark.createDataFrame([(t,) for t in wanted], "trigram string").select(F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int").alias("b"))
        buckets = sorted({r.b for r in bucket.collect()})  # no more than the query has characters
        postings = self._read("postings", have).where(F.col("bucket").isin(buckets) & F.col("trigram").isin(wanted))
        counts = {r.trigram: r.n for r in postings.groupBy("trigram").agg(F.sum("n").alias("n")).collect()}
        if len(counts) < len(wanted):
            return none
        rarest = sorted(wanted, key=lambda t: (counts[t], t))[:RAREST]
        schema = pa.schema([("generation", pa.string()), ("no", pa.int64())])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    lists: dict[str, list[np.ndarray]] = {}
                    for x in r["lists"]:
                        lists.setdefault(x["trigram"], []).append(decode(x["numbers"]))
                    if len(lists) == len(rarest):
                        both = np.unique(functools.reduce(np.intersect1d, (np.concatenate(x) for x in lists.values())) // SLOTS) + r["piece"] * PIECE
                        yield pa.RecordBatch.from_arrays([pa.array([r["generation"]] * len(both), pa.string()), pa.array(both, pa.int64())], schema=schema)

        rows = postings.where(F.col("trigram").isin(rarest)).groupBy("generation", "piece").agg(F.collect_list(F.struct("trigram", "numbers")).alias("lists"))  # at most PIECE * SLOTS numbers of each
        return rows.mapInArrow(meet, "generation string, no long")

    def rows_for(self, query: str) -> DataFrame:
        """Live rows, all those that have ``query`` in them among them; few others if it has three characters or more."""
        found = self.candidates(query)
        if found is None:
            return self.live()
        have = self.generations()
        if not have:
            return self.live()
        sizes = self._read("done", have).select("generation", "block_rows")
        found = stored(found.join(F.broadcast(sizes), "generation").select("generation", "no", F.expr("no div block_rows").alias("block")), "found")
        named = found.select("generation", "block").distinct().limit(NAMED + 1).collect()
        if not named:
            return self.live().limit(0)
        if len(named) > NAMED:
            return self.live().join(found.drop("block"), ["generation", "no"], "left_semi")
        blocks: dict[str, list[int]] = {}
        for r in named:
            blocks.setdefault(r.generation, []).append(r.block)
        texts = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self._read("texts", [g]).where(F.col("block").isin(b)) for g, b in blocks.items()))
        return self.live(texts.join(found.drop("block"), ["generation", "no"], "left_semi"))

    def ask(self, query: str, max_results: int = 10, category: str | None = None) -> DataFrame:
        """What ``search.ask`` finds in the live rows."""
        return search.ask(self.rows_for(query), query, max_results, category)
