"""Histories as graphs of commits: ancestors and topological order over tables.

Both are the solution of equations, one per commit: its layer is one more than
the largest of its parents, and it is reached if one of its children is. A
commit whose equation names one other only takes over that one's value and an
offset, whatever the value is. So rounds of pointer jumping, as many as the
logarithm of a chain's length, replace all such commits by the others that their
values come from; equations that then name one other twice, with different
offsets, keep the larger, and may name only one. This goes on until all that is
left are the values known from the start. Histories of branches that are merged
again, however long and nested, take few phases.

Equations name commits by numbers, hashes stay where the commits are. A round
writes only what it has changed, and rows that have come to a known value take
part in no further join: all of them would meet in one task.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.shared import stored

#: The values known from the start, numbers that no commit has: those are not below zero.
_ROOT, _YES, _NO = -1, -2, -3
#: Bits of a commit's number.
BITS = 63


def numbering(names: DataFrame) -> Callable[[str], Column]:
    """A function from a column to numbers, different ones for different ``names`` (name): a hash of ``BITS`` bits.
    A second hash tells if two names share a number; then all get others."""
    for seed in itertools.count():

        def number(c: str, seed: int = seed) -> Column:
            return F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), F.col(c)).bitwiseAND(F.lit((1 << BITS) - 1)))

        both = names.select(number("name").alias("number"), F.xxhash64(F.lit("second"), "name").alias("second"))
        shared = both.groupBy("number").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi")
        if not shared.limit(1).count():
            return number
    raise AssertionError  # the loop has no end


def _names(commits: DataFrame, *more: DataFrame) -> DataFrame:
    """The hashes of ``commits``, of their parents and of ``more`` (hash), with repeats."""
    own = commits.select(F.explode(F.concat(F.array("hash"), F.coalesce("parent_hashes", F.array().cast("array<string>")))).alias("name"))
    return functools.reduce(DataFrame.unionByName, (df.select(F.col("hash").alias("name")) for df in more), own)


def _followed(rows: DataFrame, by: DataFrame) -> DataFrame:
    """``rows`` (node, other, w), each ``other`` that is a node of ``by`` replaced by that one's, with its w added."""
    step = by.select(F.col("node").alias("other"), F.col("other").alias("next"), F.col("w").alias("more"))
    moved = rows.where("other >= 0").join(step, "other", "left").select("node", F.coalesce("next", "other").alias("other"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    return moved.unionByName(rows.where("other < 0").select("node", "other", "w"))


def _jumped(one: DataFrame) -> DataFrame:
    """``one`` (node, other, w; one row per node, stored) with each ``other`` followed to where it is no node itself, and w added up."""
    one = one.select("node", "other", "w")
    nodes = one.select(F.col("node").alias("other"), F.lit(True).alias("open"))
    named = one.where("other >= 0").join(nodes, "other", "left").select("node", "other", "w", F.coalesce("open", F.lit(False)).alias("open"))
    now = stored(named.unionByName(one.where("other < 0").withColumn("open", F.lit(False))), "jumps")
    done = now.where("not open")
    while now.where("open").limit(1).count():
        step = now.where("open").unionByName(done).select(F.col("node").alias("other"), F.col("other").alias("next"), F.col("w").alias("more"), F.col("open").alias("still"))
        ahead = now.where("open").join(step, "other").select("node", F.col("next").alias("other"), (F.col("w") + F.col("more")).alias("w"), F.col("still").alias("open"))
        now = stored(ahead, "jumps")
        done = done.unionByName(now.where("not open"))
    return done.drop("open")


def _equations(edges: DataFrame, yes: int | None, no: int | None) -> DataFrame:
    """node, other, w of ``edges``, with the largest w of each and without those that a node doesn't need, and n, how many its node has."""
    all_ = Window.partitionBy("node")
    rows = edges.repartition("node").groupBy("node", "other").agg(F.max("w").alias("w"))
    if yes is not None:
        seen = rows.withColumns({"sure": F.max(F.col("other") == yes).over(all_), "some": F.max(F.col("other") != no).over(all_)})
        rows = seen.where(F.when(F.col("sure"), F.col("other") == yes).when(F.col("some"), F.col("other") != no).otherwise(True)).select("node", "other", "w")
    return stored(rows.withColumn("n", F.count("*").over(all_)), "equations")


def solve(edges: DataFrame, yes: int | None = None, no: int | None = None) -> DataFrame:
    """node, other, w: the known value that each node's comes from, and what is to be added.

    ``edges`` (node, other, w; numbers) say that a node's value is the largest of the
    others' with w added; those below zero are known, all others have to be nodes. A node
    with the largest of all values, ``yes``, among its others needs no other one, and
    ``no``, the smallest, is none beside others.
    """
    solved: list[DataFrame] = []
    rest = _equations(edges, yes, no)
    while True:
        solved.append(_jumped(rest.where("n = 1")))
        left = rest.where("n > 1")
        if not left.limit(1).count():
            break
        rest = _equations(_followed(left, solved[-1]), yes, no)
    if len(solved) == 1:
        return solved[0]
    later = _jumped(functools.reduce(DataFrame.unionByName, solved[1:]))  # what was left in a phase has been solved by those after it
    return _followed(solved[0], later).unionByName(later)


def _nodes(commits: DataFrame, number: Callable[[str], Column]) -> DataFrame:
    return commits.where("hash is not null").select(number("hash").alias("node"))


def _links(commits: DataFrame, number: Callable[[str], Column]) -> DataFrame:
    """node and parent, as numbers, of every parent that ``commits`` (hash, parent_hashes) has itself; a history can be cut off."""
    pairs = commits.where("hash is not null").select(number("hash").alias("node"), F.explode("parent_hashes").alias("name")).select("node", number("name").alias("parent"))
    return stored(pairs.join(_nodes(commits, number).withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent"), "links")


def _layers(commits: DataFrame, number: Callable[[str], Column]) -> DataFrame:
    """node and layer of each commit."""
    pairs = _links(commits, number)
    roots = _nodes(commits, number).join(pairs.select("node"), "node", "left_anti")
    one = F.lit(1).cast("long").alias("w")
    edges = pairs.select("node", F.col("parent").alias("other"), one).unionByName(roots.select("node", F.lit(_ROOT).cast("long").alias("other"), one))
    return solve(edges).select("node", F.col("w").alias("layer"))


def layers(commits: DataFrame) -> DataFrame:
    """hash and layer of each commit: 1 without parents, else one more than the largest of its parents'."""
    number = numbering(_names(commits))
    named = commits.select(number("hash").alias("node"), "hash").dropDuplicates(["node"])
    return named.join(_layers(commits, number), "node").select("hash", "layer")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in ``order``: ranges are sorted by themselves, and
    the rows before each are counted."""
    at = F.monotonically_increasing_id()
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__range": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = sorted_.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    return sorted_.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def topological_pos(commits: DataFrame) -> DataFrame:
    """hash, layer, pos (from 1, without gaps) of each commit (hash, parent_hashes, timestamp):
    parents come before their children, and of one layer the older and then the one with the smaller hash."""
    number = numbering(_names(commits))
    named = commits.select(number("hash").alias("node"), "hash", "timestamp").dropDuplicates(["node"])
    rows = named.join(_layers(commits, number), "node").drop("node")
    return numbered(rows, ["layer", "timestamp", "hash"], "pos").select("hash", "layer", "pos")


def _reached(commits: DataFrame, of: DataFrame, number: Callable[[str], Column]) -> DataFrame:
    """The numbers (node) of the commits in ``of`` and of all that they descend from."""
    nodes = _nodes(commits, number)
    start = _nodes(of, number).join(nodes, "node", "left_semi")
    zero = F.lit(0).cast("long").alias("w")
    up = _links(commits, number).select(F.col("parent").alias("node"), F.col("node").alias("other"), zero)
    known = lambda df, value: df.select("node", F.lit(value).cast("long").alias("other"), zero)
    return solve(up.unionByName(known(start, _YES)).unionByName(known(nodes, _NO)), _YES, _NO).where(F.col("other") == _YES).select("node")


def ancestors(commits: DataFrame, of: DataFrame) -> DataFrame:
    """The hashes of the commits in ``of`` and of all that they descend from; hashes that ``commits`` lacks are left out."""
    number = numbering(_names(commits, of))
    return commits.select("hash").distinct().withColumn("node", number("hash")).join(_reached(commits, of, number), "node", "left_semi").select("hash")


def not_reached(commits: DataFrame, since: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """The commits, or those that ``tips`` (hash) are or descend from, without those that ``since`` (hash) are or descend from."""
    number = numbering(_names(commits, since, *([] if tips is None else [tips])))

    def among(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        reached = _reached(commits, of, number).withColumnRenamed("node", "__node")
        return rows.withColumn("__node", number("hash")).join(reached, "__node", how).select(*rows.columns)

    rows = commits if tips is None else among(commits, tips, "left_semi")
    return among(rows, since, "left_anti")
