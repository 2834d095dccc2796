"""Periodic runs of words: stretches that repeat themselves, found by tiles of each scale.

A run is a stretch of words of which those a period apart are equal, at least
twice as long as its smallest period and ``least`` words, that no neighbouring
word extends. Periods are taken by octaves. Each octave puts boundaries into a
text, about as far apart as its smallest period, so that every run of it has one
in its first words. Around each boundary lies a tile, from one step before it to
two octaves behind; tiles overlap. Two Z-functions at the boundary, of what
follows it and of what precedes it turned round, tell for every period of the
octave how far words are repeated to either side within the tile: fragments of
runs. Those of one text and period that overlap by a period are one run, and
stitching them joins what tiles have cut.

Tiles of most texts are solved where the text is read. Those of long texts are
dealt to tasks by text, octave and place. Fragments are exchanged by text and
period.

Tiles without seeds are passed over: a run of an octave begins with words of
which each starts a sequence of ``least / 2`` words that comes again within the
octave's longest period.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import stored, utf8

#: Texts of more words are tiled over several tasks, in parts of so many words at least.
LONG = 1 << 14

Octave = tuple[int, int, int]


def octaves(n: int, least: int) -> Iterator[Octave]:
    """(smallest period, one above the largest, distance of boundaries) of each octave that ``n`` words can have runs of."""
    seed = (least + 1) // 2
    top = 1 << (seed - 1).bit_length()
    yield 1, top, seed
    while 2 * top <= n:
        yield top, 2 * top, top
        top *= 2


def z_function(x: list[int], upto: int) -> list[int]:
    """How many items at i and at the start of ``x`` are equal, for i < upto."""
    n = len(x)
    z = [0] * upto
    if upto:
        z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


@functools.lru_cache(1 << 16)
def _largest_divisors(p: int) -> tuple[int, ...]:
    out, rest, d = [], p, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(p // d)
            while rest % d == 0:
                rest //= d
        d += 1
    if rest > 1:
        out.append(p // rest)
    return tuple(out)


def at_boundary(x: list[int], c: int, octave: Octave) -> Iterator[tuple[int, int, int]]:
    """(period, start, stop) of the stretches of smallest period in ``octave`` around
    place ``c`` of ``x``, as far as its tile shows them."""
    low, high, step = octave
    ahead = z_function(x[c : c + 2 * high], min(high, len(x) - c))
    before = x[max(0, c - step) : c][::-1]
    top = min(len(x), c + high - 1)
    behind = z_function([*before, -1, *x[max(0, c + low - step) : top][::-1]], len(before) + 1 + top - c - low + 1)
    for p in range(low, min(high, len(x) - c)):
        f = min(ahead[p], high)
        place = len(before) + 1 + top - c - p
        b = behind[place] if place < len(behind) else 0
        if f + b >= p and not any(ahead[q] >= p - q for q in _largest_divisors(p)):
            yield p, c - b, c + p + f


def _comes_again(x: np.ndarray, seed: int) -> np.ndarray:
    """For each place the distance to where its next ``seed`` items come again (0: nowhere)."""
    m = len(x) - seed + 1
    out = np.zeros(max(0, m), np.int64)
    if m < 2:
        return out
    h = np.zeros(m, np.uint64)
    for k in range(seed):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + m].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _ranges(again: np.ndarray, octave: Octave, seed: int) -> list[tuple[int, int]]:
    low, high, _ = octave
    near = np.flatnonzero(np.diff(np.concatenate(([0], ((again > 0) & (again < high)).view(np.int8), [0]))))
    return [(u, v + seed) for u, v in zip(near[::2].tolist(), near[1::2].tolist()) if v - u >= max(1, low - seed + 1)]


def fragments(x: np.ndarray, again: np.ndarray, octave: Octave, least: int, begin: int, end: int, first: int = 0) -> list[tuple[int, int, int]]:
    """The stretches (period, start, stop) that boundaries in [begin, end) show, where
    ``x`` has the words from number ``first`` on; those of one period that belong together are one."""
    step = octave[2]
    found: dict[int, list[list[int]]] = {}
    items: list[int] | None = None
    for u, v in _ranges(again, octave, (least + 1) // 2):
        u, v = max(u + first, begin), min(v + first, end)
        for c in range(-(-u // step) * step, v, step):
            items = x.tolist() if items is None else items
            for p, s, e in at_boundary(items, c - first, octave):
                mine = found.setdefault(p, [])
                if mine and s + first + p <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], e + first)
                else:
                    mine.append([s + first, e + first])
    return [(p, s, e) for p, each in found.items() for s, e in each]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as a number, equal words as equal ones."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))


_SCAN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("plain", pa.string()), ("text", pa.binary()), ("found", pa.bool_()), ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("low", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
_SCAN_DDL = "row long, doc_id long, plain string, text binary, found boolean, period long, start long, stop long, low long, begin long, end long, first long, ids binary"


def _scan(rows: DataFrame, least: int, long_words: int, digest: bool) -> DataFrame:
    """One row per text (``plain`` not null, with the text if ``found`` says that it may have runs), one per fragment
    (``period`` not null) and one per tile of a long text (``ids`` not null)."""
    seed = (least + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out: dict[str, list] = {name: [] for name in _SCAN.names}

                def put(**values) -> None:
                    for name in _SCAN.names:
                        out[name].append(values.get(name))

                for row, doc_id, text in zip(*(c[i : i + 256].to_pylist() for c in batch.columns)):
                    words = text.split() if text else []
                    x, found = numbered(words), False
                    again = _comes_again(x, seed)
                    for octave in octaves(len(x), least):
                        if not _ranges(again, octave, seed):
                            continue
                        if len(x) <= long_words:
                            for p, s, e in fragments(x, again, octave, least, 0, len(x)):
                                put(row=row, period=p, start=s, stop=e)
                                found = True
                        else:
                            low, high, step = octave
                            size = max(long_words, 8 * high)
                            for begin in range(0, len(x), size):
                                first = max(0, begin - step)
                                put(row=row, low=low, begin=begin, end=min(begin + size, len(x)), first=first, ids=x[first : begin + size + 2 * high].tobytes())
                                found = True
                                if len(out["row"]) > 64:
                                    yield pa.RecordBatch.from_pydict(out, _SCAN)
                                    out = {name: [] for name in _SCAN.names}
                    joined = b" ".join(words)
                    put(row=row, doc_id=doc_id, plain=hashlib.sha256(joined).hexdigest() if digest else joined.decode(), text=joined if found else None, found=found)
                yield pa.RecordBatch.from_pydict(out, _SCAN)

    return rows.mapInArrow(run, _SCAN_DDL)


def _solve_tiles(tiles: DataFrame, least: int) -> DataFrame:
    """The fragments (row, period, start, stop) of tiles of long texts."""
    schema = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    seed = (least + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["ids"], np.int32)
                octave = next(o for o in octaves(2 * r["low"] + r["end"] + 1, least) if o[0] == r["low"])
                got = fragments(x, _comes_again(x, seed), octave, least, r["begin"], r["end"], r["first"])
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "period": p, "start": s, "stop": e} for p, s, e in got], schema)

    return tiles.repartition("row", "low", "begin").mapInArrow(run, "row long, period long, start long, stop long")


def stitched(found: DataFrame, least: int) -> DataFrame:
    """The runs (row, start, length, period) of which ``found`` (row, period, start, stop) has the fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        last: list | None = None

        def whole(r: list | None) -> list[dict]:
            return [{"row": r[0], "start": r[2], "length": r[3] - r[2], "period": r[1]}] if r and r[3] - r[2] >= max(least, 2 * r[1]) else []

        for batch in batches:
            out = []
            for row, p, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if last and last[:2] == [row, p] and s + p <= last[3]:
                    last[3] = max(last[3], e)
                else:
                    out += whole(last)
                    last = [row, p, s, e]
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(whole(last), schema)

    dealt = found.select("row", "period", "start", "stop").repartition("row", "period").sortWithinPartitions("row", "period", "start")
    return dealt.mapInArrow(run, "row long, start long, length long, period long")


_RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


def _collapsed(rows: DataFrame, digest: bool) -> DataFrame:
    """doc_id, runs and the words (``text``, one space between) without repetitions."""
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(i, 256).to_pylist():
                    words = r["text"].split()
                    for x in r["runs"]:
                        a, b = x["start"] + x["period"], x["start"] + x["length"]
                        words[a:b] = [None] * (b - a)
                    kept = b" ".join(w for w in words if w is not None)
                    out.append({"doc_id": r["doc_id"], "runs": r["runs"], "collapsed": hashlib.sha256(kept).hexdigest() if digest else kept.decode()})
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("doc_id", "runs", "text").mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed string")


def find_runs(docs: DataFrame, least: int = 12, digest: bool = False, long_words: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (by start, then period) and the collapsed text of every row.

    Collapsed are the words, joined by one space, without those that any run has
    after its first period; with ``digest`` their SHA-256 (hex), so that texts
    without runs need not be written. Words are what white space of ASCII
    separates. A null or empty text has no words, no runs and collapses to an
    empty one. Repeated rows and null ids are rows like others; an empty table
    gives no rows; further columns are left out.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    scanned = stored(_scan(rows, least, long_words, digest), "scan")
    tiles = _solve_tiles(scanned.where("ids is not null").select("row", "low", "begin", "end", "first", "ids"), least)
    found = scanned.where("period is not null").select("row", "period", "start", "stop").unionByName(tiles)
    runs = stitched(found, least).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # of one text
    mine = scanned.where("found").select("row", "doc_id", "text").join(runs, "row", "left").withColumn("runs", F.coalesce("runs", F.expr(f"CAST(array() AS {_RUNS})")))
    rest = scanned.where("not found").select("doc_id", F.expr(f"CAST(array() AS {_RUNS})").alias("runs"), F.col("plain").alias("collapsed"))
    return rest.unionByName(_collapsed(mine, digest))
