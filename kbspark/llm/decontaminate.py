"""Benchmark decontamination with a generalised suffix automaton.

The test items' normalised words make one automaton. Every document streams
through it: the automaton keeps the longest suffix of the words read so far
that occurs in some item, and a word that ends such a match of ``window`` words
(or the whole of a shorter item) marks the words of that match as hit.

Items are dealt to blocks of bounded size, so that an automaton never outgrows
a worker. With one block, the usual case, documents take one narrow pass. With
several, they take one pass through a Bloom filter of the hashes of all windows;
only documents with a window that it may hold, the contaminated ones and a few
more, go on to the automata, and their hits from all blocks are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_of, stored, utf8, worker_state
from kbspark.llm.shingles import mix

#: Bytes of item texts in one automaton, which takes about 150 times as much memory.
BLOCK_BYTES = 1 << 20
#: Bits of the filter for each word of the items, and its most bits (beyond them more documents than need go on).
WORD_BITS, MOST_BITS = 32, 1 << 30
#: Bytes to what a word keeps: letters in lower case, digits and everything beyond ASCII; the rest is a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

CONTAMINATION_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans binary"
#: Columns in which hits travel from pass to pass.
SPANS, NAMES, MAYBE = "__kb_spans", "__kb_items", "__kb_maybe"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the word sequences of several items.

    ``match`` tells which words of a document lie in an occurrence of a window,
    a run of ``window`` words of an item or all words of a shorter item, and
    whose items' windows those are.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = 13):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str | None, int]] = []
        for name, words in items:
            if not words:
                continue
            last = 0
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            for i, w in enumerate(ids):
                last = self._extend(last, w)
                if i + 1 >= min(window, len(ids)):
                    ends.append((last, name, min(window, len(ids))))
        self._finish(ends)

    def _extend(self, last: int, w: int) -> int:
        """The state of the read prefix and ``w``; prefixes of earlier items share states."""
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _holder(self, state: int, n: int) -> int:
        """The suffix state of ``state`` that holds its suffix of ``n`` words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _finish(self, ends: list[tuple[int, str | None, int]]) -> None:
        found: dict[int, dict[int, set]] = {}  # state: window's length: items
        for state, name, n in ends:
            found.setdefault(self._holder(state, n), {}).setdefault(n, set()).add(name)
        self.outputs: list[tuple[tuple[int, frozenset], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = [(n, frozenset(names)) for n, names in found.get(s, {}).items()]
            self.outputs[s] = self.outputs[self.link[s]] + tuple(own)
        self.shortest = min((n for n_names in found.values() for n in n_names), default=0)
        size = max(1, len(self.vocab))
        self.pairs = np.array(sorted(a * size + b for a, s in self.next[0].items() for b in self.next[s]), np.int64)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit words as disjoint ascending ranges, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        names: set = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, names
        ids = np.fromiter((self.vocab.get(w, -1) for w in words), np.int64, len(words))
        nxt, link, length, outputs = self.next, self.link, self.length, self.outputs
        for a, b in self._runs(ids):
            state, n = 0, 0
            for i in range(a, b):
                w = int(ids[i])
                while state and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                state = nxt[state].get(w, 0)
                n = n + 1 if state else 0
                for k, of in outputs[state]:
                    if k <= n:
                        names |= of
                        start = i + 1 - k
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
        return spans, names

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words in which each two neighbours are neighbours in an
        item: no match reaches beyond one, so only those enter the automaton."""
        if self.shortest == 1:
            ok = ids >= 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
            return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        code = ids[:-1] * max(1, len(self.vocab)) + ids[1:]
        ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
        near = np.flatnonzero(ok)
        at = np.searchsorted(self.pairs, code[near])
        ok[near] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == code[near] if len(self.pairs) else False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2]) if b - a + 1 >= self.shortest]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[list[DataFrame], int]:
    """The different ``items`` in parts of about ``block_bytes`` of text, and the bytes of all."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), utf8(text_col).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [rows], total
    dealt = stored(rows.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(n)).cast("int")), "items", partition_by="block")  # so that a block is read by itself
    return [dealt.where(F.col("block") == k).drop("block") for k in range(n)], total


class WindowFilter:
    """A Bloom filter, with one hash, of the items' windows: runs of ``window`` words, or all of a shorter item."""

    def __init__(self, window: int, total: int):
        self.window, bits = window, 64
        while bits < min(total * WORD_BITS // 4, MOST_BITS):  # at least four bytes a word, as a guess
            bits *= 2
        self.bits, self.marks, self.lengths = bits, np.zeros(bits // 8, np.uint8), set()

    def _places(self, hashes: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(hashes) - n + 1, n, np.uint64)
        for j in range(n):
            h = mix(h + hashes[j : j + len(h)])
        return (h & np.uint64(self.bits - 1)).astype(np.int64)

    def add(self, words: list[bytes]) -> None:
        if n := min(self.window, len(words)):
            self.lengths.add(n)
            at = self._places(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), n)
            np.bitwise_or.at(self.marks, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def may_hold(self, words: list[bytes]) -> bool:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        for n in self.lengths:
            if n <= len(words):
                at = self._places(hashes, n)
                if (self.marks[at >> 3] >> (at & 7) & 1).any():
                    return True
        return False


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def _scan(docs: DataFrame, items: tuple[list[DataFrame], int], window: int, text_col: str, finish: Callable, schema) -> DataFrame:
    """Stream documents through each block's automaton. Hits travel in two columns to
    the last one, where ``finish(part, texts, n_words, spans, names)`` makes the
    rows that are returned."""
    context, (blocks, total) = docs.sparkSession.sparkContext, items
    at = docs.columns.index(text_col)
    texts_of = lambda part: [x.encode() if isinstance(x, str) else x for x in part.column(at).to_pylist()]

    def words_in(block: DataFrame) -> Iterator[tuple[str | None, list[bytes]]]:
        return ((r.item_id, words_of(None if r.text is None else bytes(r.text))) for r in block.toLocalIterator())  # block_bytes

    rows, clear = docs, None
    if len(blocks) > 1:
        seen = WindowFilter(window, total)
        for block in blocks:
            for _, words in words_in(block):
                seen.add(words)
        known = context.broadcast(seen)  # MOST_BITS at most

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state("decontaminate")
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    flags = [known.value.may_hold(words_of(t)) for t in texts_of(part)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(flags, pa.bool_())], names=[*part.schema.names, MAYBE])

        marked = stored(docs.mapInArrow(mark, f"{_ddl(docs)}, {MAYBE} boolean"), "marked")
        rows = marked.where(MAYBE).drop(MAYBE)

        def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    texts = texts_of(part)
                    yield finish(part, texts, [len(words_of(t)) for t in texts], [[] for _ in texts], [set() for _ in texts])

        clear = marked.where(~F.col(MAYBE)).drop(MAYBE).mapInArrow(pass_by, schema)
    rows = rows.withColumns({SPANS: F.lit(b""), NAMES: F.lit(None).cast("array<string>")})
    for k, block in enumerate(blocks):
        shared, last = context.broadcast(ItemAutomaton(words_in(block), window)), k == len(blocks) - 1

        def stream(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            worker_state("decontaminate")
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    texts = texts_of(part)
                    n_words, spans, names = [], [], []
                    for text, old, of in zip(texts, part.column(SPANS).to_pylist(), part.column(NAMES).to_pylist()):
                        words = words_of(text)
                        here, found = shared.value.match(words)
                        n_words.append(len(words))
                        spans.append(merged([*here, *map(tuple, np.frombuffer(old, "<i4").reshape(-1, 2).tolist())]) if old else here)
                        names.append({x for x in found if x is not None}.union(of or ()))
                    own = part.select(part.schema.names[:-2])
                    if last:
                        yield finish(own, texts, n_words, spans, names)
                    else:
                        packed = [pa.array([np.array(x, "<i4").tobytes() for x in spans], pa.binary()), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays([*own.columns, *packed], names=part.schema.names)

        rows = rows.mapInArrow(stream, schema if last else rows.schema)
        if k % 4 == 3 and not last:
            rows = stored(rows, "hits")
    return rows if clear is None else rows.unionByName(clear)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids of the items with
    windows in it, sorted as strings, comma-joined), contaminated (n_hit > 0 and
    n_hit at least the share ``coverage`` of n_words), spans (packed pairs of
    32-bit word positions: start, end).

    A null text has no words; items without words have no window; an item
    without id has windows, but isn't named; rows of items with one id are one
    item. Other columns are left out; an empty table gives no rows, and no items
    no hits. Null ids and repeated documents get a row each.
    """

    def digest(part, texts, n_words, spans, names) -> pa.RecordBatch:
        out = []
        for doc_id, n, ranges, of in zip(part.column(0).to_pylist(), n_words, spans, names):
            n_hit = sum(b - a for a, b in ranges)
            out.append((doc_id, n, n_hit, len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), n_hit > 0 and coverage[1] * n_hit >= coverage[0] * n, np.array(ranges, "<i4").tobytes()))
        return batch_of(out, CONTAMINATION_SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return _scan(rows, item_blocks(items, item_col, item_text_col, block_bytes), window, "text", digest, CONTAMINATION_SCHEMA)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), max_span: int | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all their columns, without the documents whose hit words are
    at least the share ``coverage`` of their words; what occurs below that share
    stays, unless ``max_span`` is set: then runs of more hit words are cut out.

    A null text and one without words stay as they are; so do repeated rows,
    each judged alone.
    """

    def clean(part, texts, n_words, spans, names) -> pa.RecordBatch:
        keep = []
        for k, (n, ranges) in enumerate(zip(n_words, spans)):
            n_hit = sum(b - a for a, b in ranges)
            keep.append(not (n_hit and coverage[1] * n_hit >= coverage[0] * n))
            if max_span is not None and (long := [s for s in ranges if s[1] - s[0] > max_span]):
                texts[k] = cut_words(texts[k], long)
        if max_span is not None:
            at = part.schema.get_field_index(text_col)
            part = part.set_column(at, part.schema.field(at), pa.array([None if x is None else x.decode() for x in texts], part.schema.field(at).type))
        return part.filter(pa.array(keep, pa.bool_()))

    return _scan(docs, item_blocks(items, item_col, item_text_col, block_bytes), window, text_col, clean, docs.schema)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span.

    >>> cut_words(b"One, two three. Four", [(1, 3)])
    b'One, . Four'
    """
    is_word = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join((*out, text[at:]))
