"""The prefix trie of conversations, built as a burst trie over tables.

A conversation is the sequence of its turns' digests; equal sequences are one
record with a count. A container holds the records below a trie head, a common
prefix. A container with too many records bursts: its head grows by the prefix
that all its records share, and its records go on to smaller containers by their
next turn. Rounds of this are plain aggregations; only the figures of burst
containers, of which a bounded number is large enough, are broadcast. Containers
that remain are sorted and swept into nodes in one pass each, which keeps the
path to the last record and what of its nodes' children is done. What
containers hold in all is added up along the heads above them.

Memory: a conversation is one record of some 20 bytes per turn, whatever its
texts; the digests of members that end at a node are taken over sorted pieces.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import stored

#: A container bursts if it has more records than a HEADS-th of all, and LEAST.
HEADS, LEAST = 4096, 256
#: Characters of a piece of a list of members.
PIECE = 1 << 16
_ID = 16  # bytes of a turn's digest

_CLASS = pa.schema([("digest", pa.string()), ("conv", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("seq", pa.binary()), ("sizes", pa.list_(pa.int64()))])
_CLASS_DDL = "digest string, conv long, n long, ids string, seq binary, sizes array<long>"
_NODE = pa.schema([(x, pa.int64()) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string()), ("chain", pa.list_(pa.string()))])
_NODE_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chain array<string>"
_COLUMNS = _NODE.names[:-1]


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (a 16-byte digest per turn) and sizes (bytes of each turn's text), by turn, null ones first.

    Null roles and texts are empty ones. Turns of one number are ordered by their digests. Rows without a conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("id"), F.octet_length(text).cast("long").alias("size"))
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("t"))
    return each.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("seq"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def classes(seqs: DataFrame) -> DataFrame:
    """seq, sizes, n, conv (smallest) and ends_sha256 of the conversations of each different sequence of ``seqs`` (a stored table)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, size = None, [], 0

        def done() -> list[dict]:
            return [last | {"n": len(ids), "ids": ",".join(ids)}] if ids else []

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last is None or r["digest"] != last["digest"] or size > PIECE:
                    out += done()
                    last, ids, size = r, [], 0
                ids.append(str(r["conv"]))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_pylist(out, _CLASS)
        yield pa.RecordBatch.from_pylist(done(), _CLASS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, hashlib.sha256()

        def done() -> list[dict]:
            return [last | {"ids": sha.hexdigest()}] if last else []

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last and r["digest"] == last["digest"]:
                    last["n"] += r["n"]
                    sha.update(b"," + r["ids"].encode())
                else:
                    out += done()
                    last, sha = r, hashlib.sha256(r["ids"].encode())
            yield pa.RecordBatch.from_pylist(out, _CLASS)
        yield pa.RecordBatch.from_pylist(done(), _CLASS)

    order = ("digest", "conv")
    rows = seqs.select(F.md5("seq").alias("digest"), F.col("conv_id").alias("conv"), "seq", "sizes").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, _CLASS_DDL)
    return rows.repartition("digest").sortWithinPartitions(*order).mapInArrow(whole, _CLASS_DDL).select("seq", "sizes", "n", "conv", F.col("ids").alias("ends_sha256"))


def _common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share at the start."""
    n = min(len(a), len(b)) // _ID
    low, high = 0, n  # binary search: comparing whole prefixes is fast
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * _ID] == b[: mid * _ID]:
            low = mid
        else:
            high = mid - 1
    return low


def _burst(open_: DataFrame, limit: int) -> DataFrame:
    """The containers of ``open_`` that burst: their figures, and ``to``, the depth to which all their records agree."""
    figures = open_.groupBy("key", "base", "parent", "chain").agg(F.count("*").alias("records"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min(F.struct("seq", "sizes")).alias("low"), F.max("seq").alias("high"))
    large = figures.where((F.col("records") > limit) | (F.col("base") < 0))
    names = ["key", "base", "parent", "chain", "n", "conv"]

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("base", pa.int64()), ("parent", pa.int64()), ("chain", pa.list_(pa.string())), ("n", pa.int64()), ("conv", pa.int64()), ("to", pa.int64()), ("sizes", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                to = _common(r["low"]["seq"], r["high"])
                out.append({c: r[c] for c in names} | {"to": to, "sizes": r["low"]["sizes"][max(0, r["base"]) : to]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return large.mapInArrow(agree, "key string, base long, parent long, chain array<string>, n long, conv long, to long, sizes array<long>")


def _sweep(rows: DataFrame) -> DataFrame:
    """The nodes of containers, and a row of each container (``chain`` not null) with the sums of its top node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # depth, conv, n, children, leaves, saved, size, ends, rows of children that are done
        last: dict | None = None
        out: list[tuple] = []

        def batch_of_nodes() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(_NODE)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)

        def pop() -> None:
            depth, conv, n, children, leaves, saved, size, ends, done = stack.pop()
            leaves, saved = leaves if children else 1, saved + (n - 1) * size
            out.extend((c, depth + 1, conv, *rest, None) for c, *rest in done)
            node = (conv, n, children, leaves, saved, ends)
            if stack:
                above = stack[-1]
                above[1] = conv if above[1] is None else min(above[1], conv)
                above[2] += n
                above[3] += 1
                above[4] += leaves
                above[5] += saved
                above[8].append(node)
            else:
                out.append((conv, depth, last["parent"], n, children, leaves, saved, ends, None))
                out.append((None, None, None, None, None, leaves, saved, None, last["chain"]))

        for batch in batches:
            for r in batch.to_pylist():
                same = last is not None and r["key"] == last["key"]
                shared = _common(last["seq"], r["seq"]) if same else r["base"]
                while stack and not (same and stack[-1][0] <= shared):
                    pop()
                    if len(out) > 8192:
                        yield batch_of_nodes()
                for depth in range(shared + 1, len(r["seq"]) // _ID + 1):
                    stack.append([depth, None, 0, 0, 0, 0, r["sizes"][depth - 1], None, []])
                top = stack[-1]
                top[1], top[2], top[7] = r["conv"], r["n"], r["ends_sha256"]
                last = r
        while stack:
            pop()
        yield batch_of_nodes()

    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, _NODE_DDL)


def _head_nodes(heads: DataFrame) -> DataFrame:
    """The nodes on the paths of burst containers, given what lies below each (children, leaves, saved)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                saved = r["saved"] or 0
                for depth in range(r["to"], r["base"], -1):
                    saved += (r["n"] - 1) * (r["sizes"][depth - 1 - max(0, r["base"])] if depth else 0)
                    last, first = depth == r["to"], depth == r["base"] + 1
                    out.append({"conv_id": r["conv"], "depth": depth, "parent_conv_id": r["parent"] if first else r["conv"], "n_convs": r["n"], "n_children": (r["children"] or 0) if last else 1, "n_leaves": r["leaves"] or 1, "saved_tokens": saved, "ends_sha256": r["ends_sha256"] if last else None})
            yield pa.RecordBatch.from_pylist(out, _NODE)

    return heads.mapInArrow(run, _NODE_DDL)


def trie_of(seqs: DataFrame, heads: int = HEADS, least: int = LEAST) -> DataFrame:
    """The nodes of the trie of ``seqs`` (conv_id, seq, sizes; one row per conv_id), as ``prefix_trie`` has them."""
    records = stored(classes(stored(seqs, "sequences")), "records")
    limit = max(least, records.count() // heads)
    open_ = records.select("*", F.lit("").alias("key"), F.lit(-1).cast("long").alias("base"), F.lit(None).cast("long").alias("parent"), F.expr("CAST(array() AS array<string>)").alias("chain"))
    burst, kept = [], []
    while True:
        large = stored(_burst(open_, limit), "heads")
        if not large.limit(1).count():
            kept.append(open_)
            burst.append(large.withColumn("ends_sha256", F.lit(None).cast("string")))
            break
        mark = F.broadcast(large.select("key", "to", F.col("conv").alias("head_conv")))  # at most ``heads`` rows and one
        met = open_.join(mark, "key")
        ended = met.where(F.length("seq") == _ID * F.col("to")).select("key", "ends_sha256")
        burst.append(large.join(ended, "key", "left"))
        kept.append(open_.join(mark, "key", "left_anti"))
        onward = met.where(F.length("seq") > _ID * F.col("to"))
        key = F.md5(F.substring(F.col("seq"), F.lit(1), (_ID * (F.col("to") + 1)).cast("int")))
        open_ = stored(onward.select("seq", "sizes", "n", F.col("conv"), "ends_sha256", key.alias("key"), F.col("to").alias("base"), F.col("head_conv").alias("parent"), F.array_append("chain", F.col("key")).alias("chain")), "open")
    tops, rest = functools.reduce(DataFrame.unionByName, burst), functools.reduce(DataFrame.unionByName, kept)
    tops, swept = stored(tops, "tops"), stored(_sweep(rest), "nodes")
    own = (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    sums = swept.where("chain is not null").select("chain", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(tops.select("chain", F.lit(0).cast("long").alias("leaves"), own.alias("saved")))
    sums = sums.select(F.posexplode("chain").alias("at", "key"), (F.col("at") == F.size("chain") - 1).cast("long").alias("child"), "leaves", "saved")
    sums = sums.groupBy("key").agg(F.sum("child").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    nodes = swept.where("chain is null").unionByName(_head_nodes(tops.join(sums, "key", "left")))
    return nodes.select(*_COLUMNS).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def prefix_trie(conversations: DataFrame, heads: int = HEADS, least: int = LEAST) -> DataFrame:
    """A row for each different sequence of a conversation's first turns, the empty one included.

    conv_id is the smallest member (conversation that starts so), depth the
    number of turns, parent_conv_id the smallest member of the sequence without
    its last turn (null at depth 0). n_convs counts members, n_children the
    sequences that are longer by one turn, n_leaves those in the subtree that
    none is longer than, saved_tokens adds up over the subtree (members - 1)
    times the bytes of the last text. ends_sha256 is the SHA-256 of the members
    that end there, ascending, with commas. Equal turns have equal role and text;
    null ones count as empty. Rows without a conv_id are left out; repeated rows
    are turns of their own; an empty table gives no rows.
    """
    return trie_of(sequences(conversations), heads, least)
