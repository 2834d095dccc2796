"""Connected components of an undirected graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import HOT_KEYS, HOT_LEAST, hot_keys, packed, spread_join, stored


def _with_least(rows: DataFrame, n: int, of: str) -> DataFrame:
    """``rows`` (u, v; a stored table of ``n`` rows) with the smallest v that node ``of`` (u or v) has as a u, as m; null
    if it has none. What belongs to a node with very many rows, of which at most HOT_KEYS can be, is broadcast to them."""
    rows = packed(rows, n, 1)
    least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", of)
    limit = max(HOT_LEAST, n // HOT_KEYS)
    if n <= limit:
        return rows.join(least, of, "left")
    often = rows.groupBy(of).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(of)
    hot = F.broadcast(packed(often.join(least, of, "left").select(of, F.lit(True).alias("hot"), F.col("m").alias("hot_m")), n, 1))
    marked = rows.join(hot, of, "left")
    return marked.where("hot").select("u", "v", F.col("hot_m").alias("m")).unionByName(marked.where("hot is null").select("u", "v").join(least, of, "left"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b; stored tables); the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): each
    step hooks a node's neighbours to its smallest one, in a number of rounds
    logarithmic in practice. Edges point from the larger node to the smaller, so
    a step makes one edge of each at most: its result, stored in the shared
    folder, is never larger than its input. A node with very many neighbours is a
    plain aggregate, which is broadcast to them, never one group. Each step takes
    as many tasks as its edges are worth.
    """
    edges = stored(packed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), edges.count(), 1).distinct(), "edges")
    before = n = edges.count()
    while n:
        large = _with_least(edges, n, "v").select("u", F.coalesce("m", "v").alias("v"))
        large = stored(packed(packed(large, n, 1).distinct(), n, 1), "large")
        small = _with_least(large, n, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(packed(packed(small, n, 1).distinct(), n, 1), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            break
        before, n = now, now[0]
    tops = packed(edges, n, 1).select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return packed(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops), 2 * n)


def extended(label: DataFrame, edges: DataFrame) -> DataFrame:
    """``label`` (node, component; of ``components``) with further ``edges`` (a, b; stored tables). Only
    components that these join are looked at again, each as one node, not all that was linked before."""
    n = edges.count()
    if not n:
        return label
    most = label.count() + 2 * n
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    ends = packed(ends, 2 * n).distinct().join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    ends = stored(packed(ends, most), "ends")
    named = packed(edges, n)
    for p, other in (("a", "b"), ("b", "a")):
        named = packed(spread_join(named, ends.select(F.col("node").alias(p), F.col("component").alias(p + "_of")), [p], hot_keys(edges, [p]), other), n)
    tops = components(stored(packed(named.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).where("a <> b"), n, 1), "named"))
    nodes = stored(packed(packed(label.unionByName(ends), most, 1).distinct(), most, 1), "nodes")
    n = nodes.count()
    names = packed(nodes, n).select("component").distinct().join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    names = packed(names.select("component", F.coalesce("top", "component").alias("top")), n)
    return packed(spread_join(packed(nodes, n), names, ["component"], hot_keys(nodes, ["component"]), "node").select("node", F.col("top").alias("component")), n)
