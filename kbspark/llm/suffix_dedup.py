"""Removal of long repeated byte strings with suffix arrays in a logarithmic family.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier
(in a document of a smaller id, or earlier in its own). The work is dealt out by
content, so that equal strings meet in one task and nothing else has to:

1.  Anchors. Among the 32-byte strings within a window of ``length`` bytes, the one
    with the smallest hash is the window's anchor; equal windows have equal
    anchors at equal places. About one position in forty is an anchor. Anchors
    that occur once in the corpus cannot lie in a repeated window.
2.  Pieces. Around each repeated anchor, the bytes of just those windows whose
    anchor it is make a piece; pieces are dealt by the anchor's hash. Of an anchor with
    more pieces than a task's share, windows are dealt one by one, by the hash of their
    own bytes, unless the whole piece is a copy that the sending task has seen.
    The number of parts grows with the bytes of pieces, so a task's state doesn't.
3.  Index family. A task takes its pieces in the order of documents, in batches. Each
    batch gets a suffix array, is matched within itself and merge-scanned against
    the sorted levels of earlier batches; then it becomes a level itself, and
    levels of about equal size are merged, so that there are logarithmically
    many. A window found earlier marks its bytes.
4.  The marked ranges go back to their documents, which are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kbspark.llm.common import HOT_KEYS, batch_of, hot_keys, spread_join, stored, utf8, worker_state
from kbspark.llm.shingles import mix

#: Bytes of the strings among which a window's anchor is chosen.
ANCHOR_BYTES = 32
#: Pieces of one anchor that one task may get, if that isn't more than its share and more than HOT_LEAST; a more
#: frequent anchor's windows are dealt by their own bytes.
HOT_PIECES = 50_000
#: One document in OFTEN_SAMPLE is looked at first for anchors that are so frequent that even one row a block is too much.
OFTEN_SAMPLE = 64
#: Anchors with fewer occurrences (among all, or in that sample) are never dealt apart.
HOT_LEAST = 1000
#: Hot anchors that are broadcast; if there are more, the marks go to the anchors' rows by a join.
HOT_BROADCAST = 500_000
#: Bytes of pieces in a batch that gets a suffix array, and in a task, whose levels take about five times as much memory.
BATCH_BYTES, PART_BYTES = 1 << 20, 32 << 20
#: Pieces and anchors that a task remembers in order to send copies only once.
SEEN = 200_000
_ODD = 0x9E3779B97F4A7C15  # multiplier of the polynomial hash


class Roller:
    """Hashes of all strings of ``n`` bytes in a text: a polynomial modulo 2**64, finalised."""

    def __init__(self, n: int):
        self.n, self.inverse = n, pow(_ODD, -1, 1 << 64)
        self.power = self.back = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.power) < size:
            self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * size, _ODD, np.uint64))), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * size, self.inverse, np.uint64))), dtype=np.uint64)

    def __call__(self, b: np.ndarray) -> np.ndarray:
        self._grow(len(b) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[: len(b)], dtype=np.uint64)))
        return mix((total[self.n :] - total[: -self.n]) * self.back[: len(b) - self.n + 1])

    def at(self, b: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The hashes of the strings at ``places`` alone."""
        self._grow(self.n)
        return mix(((b[places[:, None] + np.arange(self.n)].astype(np.uint64) + np.uint64(1)) * self.power[: self.n]).sum(axis=1, dtype=np.uint64))


def anchors(text: bytes, length: int, roll: Roller, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a text's windows: (hash, place, first window, last window);
    a window is named by its start. Of equal hashes in a window the first counts."""
    found = [_anchors(text[c : c + chunk + length - 1], length, roll, c) for c in range(0, len(text) - length + 1, chunk)]
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    for before, after in zip(found, found[1:]):
        if before[1][-1] == after[1][0]:  # one anchor on both sides of the cut
            after[2][0] = before[2][-1]
            for x in before:
                x.resize(len(x) - 1, refcheck=False)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(text: bytes, length: int, roll: Roller, base: int) -> list[np.ndarray]:
    h = roll(np.frombuffer(text, np.uint8))
    best, at, span, w = h, np.arange(len(h)), 1, length - roll.n + 1
    while span < w:  # the smallest hash of each w in a row, by doubling
        step = min(span, w - span)
        later = best[step:] < best[:-step]
        at = np.where(later, at[step:], at[:-step])
        best = np.where(later, best[step:], best[:-step])
        span += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return [h[at[first]], at[first] + base, first + base, last + base]


def anchor_rows(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """h, the ``keys`` of a document, place (packed, see ``packed``), n and repeated of
    every anchor. A block of documents tells its first of several equal anchors
    with their number n, and those besides with n = 0 and ``repeated``, as they are
    known to be repeated: so a frequent anchor is few rows that have to be counted."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, place, *ids = (np.concatenate(x) for x in zip(*held))
        _, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        number = np.zeros(len(h), np.int32)
        number[first] = n
        columns = [pa.array(h.view(np.int64)), *map(pa.array, ids), pa.array(place), pa.array(number)]
        return pa.RecordBatch.from_arrays(columns, names=["h", *keys, "place", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        roll, held, size = Roller(ANCHOR_BYTES), [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for *ids, text in zip(*(c[i : i + 256].to_pylist() for c in batch.columns)):
                    h, at, first, last = anchors(text, length, roll)
                    if len(h):
                        held.append((h, packed(at, first, last), *(np.full(len(h), x) for x in ids)))
                        size += len(h)
                    if size > 500_000:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return rows.select(*keys, "text").mapInArrow(emit, ", ".join([*(f"{c} long" for c in ("h", *keys, "place")), "n int"]))


def often_anchors(rows: DataFrame, keys: list[str], length: int) -> DataFrame | None:
    """h of the anchors, HOT_KEYS at most, that one document in OFTEN_SAMPLE shows to be very frequent
    (and so repeated); None if there are none. They only decide how the work is dealt."""
    some = anchor_rows(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(OFTEN_SAMPLE)) == 0), keys, length)
    often = stored(some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_LEAST), "often")
    total = often.agg(F.sum("n")).first()[0] or 0
    often = often.where(F.col("n") > total // HOT_KEYS).select("h", F.lit(True).alias("often"))
    return often if total and often.limit(1).count() else None


#: Bits of how far before its anchor a window can begin, plus one bit that tells of a hot anchor.
REACH_BITS = 15


def packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's place, and how far before it its first and last window begin, in one number, whose lowest bit is free."""
    return (at << REACH_BITS | at - first) << REACH_BITS + 1 | at - last << 1


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, the lowest bit) of anchors."""
    at, mask = place >> 2 * REACH_BITS + 1, (1 << REACH_BITS) - 1
    return at, at - (place >> REACH_BITS + 1 & mask), at - (place >> 1 & mask), place & 1


PIECES = "key long, doc_id long, text_id long, start int, n int, piece binary"


def piece_rows(marked: DataFrame, length: int) -> DataFrame:
    """The pieces of documents (places: packed ones of repeated anchors): key, doc_id,
    text_id, start and n (first window, windows), piece. Pieces that the task has
    sent for an earlier document have no bytes: their windows are known to be
    repeated, and those next to each other are one row, keyed by the document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        roll, whole, seen = Roller(ANCHOR_BYTES), Roller(length), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(i, 256)
                names = part.schema.names
                text_ids = part.column("text_id").to_pylist() if "text_id" in names else [0] * part.num_rows
                for doc, text_id, text, places in zip(part.column("doc_id").to_pylist(), text_ids, part.column("text").to_pylist(), part.column("places").to_pylist()):
                    at, first, last, hot = unpacked(np.sort(np.array(places, np.int64)))
                    b = np.frombuffer(text, np.uint8)
                    keys = roll.at(b, at).view(np.int64)
                    parts = list(zip(keys.tolist(), first.tolist(), last.tolist(), (hot == 1).tolist()))[::-1]
                    while parts:
                        key, a, z, split = parts.pop()
                        piece = text[a : z + length]
                        d, here = xxhash.xxh3_128_digest(piece), (doc, text_id, a)
                        if d in seen and seen[d] < here:
                            if out and out[-1][5] is None and out[-1][1:3] == (doc, text_id) and out[-1][3] + out[-1][4] == a:
                                out[-1] = (*out[-1][:4], z - out[-1][3] + 1, None)
                            else:
                                out.append((doc, doc, text_id, a, z - a + 1, None))
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[d] = here
                        if split:  # a copy of a whole piece has gone above; of another, window by window
                            parts += [(k, a + j, a + j, False) for j, k in enumerate(whole(b[a : z + length]).view(np.int64).tolist())][::-1]
                        else:
                            out.append((key, doc, text_id, a, z - a + 1, piece))
                yield batch_of(out, PIECES)

    return marked.mapInArrow(emit, PIECES)  # of all columns: the exchange of the texts then serves both joins


_END = np.zeros(8, np.uint8)


def _words(ended: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a text (with _END after it) on as one
    big-endian number; a view of the text, so it takes no memory."""
    return np.ndarray(len(ended) - 8, ">u8", ended, strides=(1,))


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
    return rank


def _joined(ranks: list[np.ndarray], n: int) -> np.ndarray:
    """The ranks (all below ``n``) of strings that follow each other as one number."""
    out = ranks[0]
    for r in ranks[1:]:
        out = out * n + r
    return out


class Level:
    """A sorted array of places in a text (with _END after it), all different in
    their first ``length`` bytes, and the first eight bytes at each."""

    def __init__(self, ended: np.ndarray, places: np.ndarray, heads: np.ndarray, length: int):
        self.ended, self.places, self.heads, self.length = ended, places, heads, length

    def _compare(self, mine: np.ndarray, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each of my places against another text's place with the same first eight bytes."""
        own, out, open_ = _words(self.ended), np.zeros(len(mine), np.int8), np.arange(len(mine))
        for step in [*range(8, self.length - 8, 8), self.length - 8]:
            a, b = own[mine[open_] + step].astype(np.uint64), words[places[open_] + step].astype(np.uint64)
            out[open_[a < b]], out[open_[a > b]] = -1, 1
            open_ = open_[a == b]
            if not len(open_):
                break
        return out

    def locate(self, words: np.ndarray, places: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each place of another text belongs in my order, and whether I have its string."""
        low, high = np.searchsorted(self.heads, heads, "left"), np.searchsorted(self.heads, heads, "right")
        found, todo = np.zeros(len(places), bool), np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            c = self._compare(self.places[mid], words, places[todo])
            low[todo[c < 0]] = mid[c < 0] + 1
            high[todo[c >= 0]] = mid[c >= 0]
            found[todo[c == 0]] = True
            todo = todo[low[todo] < high[todo]]
        return low, found

    def merged(self, other: Level, at: np.ndarray | None = None) -> Level:
        """Both levels as one; ``at`` is where the other's places belong, if that is known."""
        if at is None:
            at, _ = self.locate(_words(other.ended), other.places, other.heads)
        moved = other.places + np.int32(len(self.ended) - 8)
        return Level(np.concatenate((self.ended[:-8], other.ended)), np.insert(self.places, at, moved), np.insert(self.heads, at, other.heads), self.length)


class IndexFamily:
    """Levels of sorted strings of ``length`` bytes, of geometrically growing sizes."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, text: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Take in the strings at ``windows`` (ascending) of ``text``; returns which
        of them came before, in an earlier batch or at an earlier window."""
        ended = np.concatenate((text, _END))
        words = _words(ended)
        # a suffix array by ranks of ever longer strings, put together from ``k`` shorter ones, as deep as needed
        n, k = len(words), 3 if len(words) < 1 << 21 else 2
        rank, span = _ranks(words.astype(np.uint64)), 8
        while 4 * k * span <= self.length:
            end = len(rank) - (k - 1) * span
            rank = _ranks(_joined([rank[j * span : j * span + end] for j in range(k)], n))
            span *= k
        # from here on for the windows alone: a few strings of ``span`` bytes cover one
        parts = [rank[windows + min(j, self.length - span)] for j in range(0, self.length, span)]
        while len(parts) > k:
            parts = [_ranks(_joined(parts[i : i + k], n)) for i in range(0, len(parts), k)]
        key = _joined(parts, n)
        order = np.argsort(key)
        ordered = key[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        before = np.ones(len(windows), bool)
        mine = np.minimum.reduceat(order, starts)  # the first of equal strings, in the order of strings
        heads = words[windows[mine]].astype(np.uint64)
        at = None
        for level in self.levels:
            at, found = level.locate(words, windows[mine], heads)
            mine, heads, at = mine[~found], heads[~found], at[~found]
        before[mine] = False
        self.levels.append(Level(ended, windows[mine].astype(np.int32), heads, self.length))
        while len(self.levels) > 1 and len(self.levels[-2].places) <= 2 * len(self.levels[-1].places):
            last = self.levels.pop()
            self.levels[-1], at = self.levels[-1].merged(last, at), None
        return before


RANGES = "doc_id long, text_id long, start int, stop int"


def repeated_ranges(pieces: DataFrame, length: int, parts: int) -> DataFrame:
    """The byte ranges that repeated windows cover: doc_id, text_id, start, stop.
    Pieces are dealt to ``parts`` tasks, each of which remembers at most SEEN whole
    pieces besides the levels of its own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, seen, batch_rows, size, last = IndexFamily(length), {}, [], 0, None

        def match(rows: list[tuple]) -> Iterator[tuple]:
            text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            n = np.array([r[4] for r in rows])
            at = np.cumsum([0, *(len(r[5]) for r in rows[:-1])])
            head = np.cumsum([0, *n[:-1]])
            windows = np.repeat(at - head, n) + np.arange(n.sum())
            piece = np.repeat(np.arange(len(rows)), n)
            hit = np.flatnonzero(family.add(text, windows))
            if len(hit):
                cut = np.flatnonzero((np.diff(hit) > length) | (np.diff(piece[hit]) != 0))
                for a, b in zip(hit[np.concatenate(([0], cut + 1))].tolist(), hit[np.concatenate((cut, [len(hit) - 1]))].tolist()):
                    _, doc, text_id, start, _, _ = rows[piece[a]]
                    yield doc, text_id, start + a - int(head[piece[a]]), start + b - int(head[piece[a]]) + length

        for batch in batches:
            known = batch.column(5).is_null()
            if known.true_count:
                _, doc, text_id, start, n, _ = batch.filter(known).columns
                yield pa.RecordBatch.from_arrays([doc, text_id, start, pc.add(pc.add(start, n), pa.scalar(length - 1, pa.int32()))], names=["doc_id", "text_id", "start", "stop"])
                batch = batch.filter(pc.invert(known))
            for i in range(0, batch.num_rows, 4096):
                out = []
                for row in zip(*(c[i : i + 4096].to_pylist() for c in batch.columns)):
                    _, doc, text_id, start, n, piece = row
                    here = (doc, text_id, start)
                    if len(seen) >= SEEN:  # the family still finds the windows of pieces that are forgotten here
                        seen.clear()
                    if seen.setdefault(xxhash.xxh3_128_digest(piece), here) != here:
                        out.append((doc, text_id, start, start + n - 1 + length))
                    elif here != last:  # of a repeated row, whichever batch took it
                        last = here
                        batch_rows.append(row)
                        size += len(piece)
                    if size >= BATCH_BYTES:
                        out += match(batch_rows)
                        batch_rows, size = [], 0
                yield batch_of(out, RANGES)
        if batch_rows:
            yield batch_of(list(match(batch_rows)), RANGES)

    return pieces.repartition(parts, "key").sortWithinPartitions("doc_id", "text_id", "start").mapInArrow(scan, RANGES)


def cut_repeats(docs: DataFrame, length: int = 100, whole_characters: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay; with
    ``whole_characters``, without what is left of a character that a cut went
    through), and the other columns of ``docs``, of every document.

    A null text is empty and stays so; texts of fewer than ``length`` bytes lose
    nothing. A repeated row is judged once and gets the same result each time;
    rows of one id with different texts follow each other in an order of their
    own. A row with a null id is neither compared nor cut. An empty table gives
    no rows. Other columns keep their names unless one of these has it.
    """
    if not ANCHOR_BYTES < length < 1 << REACH_BITS:
        raise ValueError(f"length must be more than {ANCHOR_BYTES} and less than {1 << REACH_BITS}")
    spark = docs.sparkSession
    names = {"doc_id", "text_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "places", "cuts"}
    extra = [c for c in docs.columns if c not in (id_col, text_col) and c not in names]
    # a column that is right already stays bare: an alias on one side would keep the joins from sharing their exchange
    the_id = F.col("doc_id") if id_col == "doc_id" and docs.schema["doc_id"].dataType == LongType() else F.col(id_col).cast("long").alias("doc_id")
    rows = docs.select(the_id, F.coalesce(utf8(text_col), F.lit(b"")).alias("text"), *extra)
    clash = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("lo <> hi").limit(1).count()
    keys = ["doc_id"]
    if clash:
        rows, keys = rows.withColumn("text_id", F.xxhash64("text")), ["doc_id", "text_id"]
    known = rows.where("doc_id is not null")

    counted = anchor_rows(known, keys, length)
    often = often_anchors(known, keys, length)
    if often is not None:  # these were found twice and more
        counted = counted.join(F.broadcast(often), "h", "left").withColumn("n", F.when(F.col("often").isNull(), F.col("n")).otherwise(0)).drop("often")
    # those with n = 0 are known to be repeated, so they are spread and not counted
    group = F.when(F.col("n") > 0, F.col("h")).otherwise(F.xxhash64("doc_id", "place"))
    counted = counted.withColumn("total", F.when(F.col("n") > 0, F.sum("n").over(Window.partitionBy(group))))
    repeated = stored(counted.where("total is null or total > 1").drop("n"), "repeated")
    n_places = repeated.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_places * 2 * length // PART_BYTES)
    share = min(HOT_PIECES, max(HOT_LEAST, n_places // parts))
    marks = repeated.where("total is not null").groupBy("h").agg(F.max((F.col("total") > share).cast("int")).alias("hot"))
    if often is not None:
        marks = marks.unionByName(often.select("h", F.lit(1).alias("hot")))
    hot, place = stored(marks.where("hot = 1"), "hot"), F.col("place")
    if n_hot := hot.count():
        if n_hot <= HOT_BROADCAST:
            repeated = repeated.join(F.broadcast(hot), "h", "left")
        else:
            repeated = spread_join(repeated, stored(marks, "marks"), ["h"], hot_keys(repeated, ["h"]), "doc_id")
        place = place + F.coalesce("hot", F.lit(0))
    places = repeated.groupBy(keys).agg(F.collect_set(place).alias("places"))  # a document's own
    ranges = repeated_ranges(piece_rows(known.join(places, keys), length), length, parts)
    cuts = ranges.groupBy(keys).agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    cut_rows = known.join(cuts, keys, "left").unionByName(rows.where("doc_id is null").withColumn("cuts", F.lit(None).cast("array<struct<start:int,stop:int>>")))
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}
    schema = ", ".join([f"{c} {k}" for c, k in kinds.items()] + [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*extra).schema])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, out = batch.slice(i, 512), []
                for doc, text, spans in zip(*(part.column(j).to_pylist() for j in range(3))):
                    kept, at, removed, n = [], 0, 0, 0
                    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                        if a > at or (n == 0):
                            kept.append(text[at:a])
                            n, removed = n + 1, removed + b - a
                            at = b
                        elif b > at:
                            removed, at = removed + b - at, b
                    rest = b"".join((*kept, text[at:]))
                    if n and whole_characters:
                        rest = rest.decode("utf-8", "ignore").encode()
                    out.append((doc, len(text), removed, n, rest))
                base = batch_of(out, ", ".join(f"{c} {k}" for c, k in kinds.items()))
                yield pa.RecordBatch.from_arrays([*base.columns, *(part.column(j) for j in range(3, part.num_columns))], names=[*result, *extra])

    return cut_rows.select("doc_id", "text", "cuts", *extra).mapInArrow(cut, schema)


def drop_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, their texts without repeated strings; what
    is left of a character that a cut went through goes as well. Documents of
    which nothing but white space is left go; null, empty and untouched ones stay.
    """
    own = {c: f"__kb_{i}" for i, c in enumerate(docs.columns) if c not in (id_col, text_col)}
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(text_col).isNull().alias("__kb_null"), *(F.col(c).alias(n) for c, n in own.items()))
    cut = cut_repeats(plain, length, whole_characters=True)
    text = F.when(F.col("__kb_null"), F.lit(None)).otherwise(F.col("kept").cast("string"))
    rows = cut.withColumn("text", text).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return rows.select(*(F.col({id_col: "doc_id", text_col: "text"}.get(c) or own[c]).alias(c) for c in docs.columns))
