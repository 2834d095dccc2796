"""Bringing the findings of several models together.

``tagged`` entries carry seq, the order in which they came; whatever is first
is first by seq, so that results don't depend on partitions. Entries of one
category that say nearly the same are a cluster, named by the seq of its leader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import rules, text
from kbspark.shared import stored


def similar_texts(distinct: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (a, b) of seqs, a before b, of strings (category, seq, k) in the same
    category with at most ``most`` edits between them.

    Of a string cut into most + 1 parts, one occurs unchanged in any other within
    that distance, moved by at most ``most`` places: so parts are joined on
    equality, and what meets is verified. Strings too short to be cut meet all
    that are short enough.
    """
    parts, n = most + 1, F.col("n")
    rows = distinct.select("category", "seq", "k", F.char_length("k").alias("n"))

    def start(length: Column, i: Column) -> Column:
        return F.floor(length * i / parts).cast("int")

    numbers = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i")
    cut = rows.where(n >= parts).select("*", numbers).select("category", F.col("n").alias("length"), "i", F.substring("k", start(n, F.col("i")) + 1, start(n, F.col("i") + 1) - start(n, F.col("i"))).alias("part"), "seq", "k")
    shifts = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")
    lengths = F.explode(F.sequence(F.greatest(n - most, F.lit(parts)), n)).alias("length")
    at = start(F.col("length"), F.col("i")) + F.col("shift")
    size = start(F.col("length"), F.col("i") + 1) - start(F.col("length"), F.col("i"))
    look = rows.where(n >= parts).select("*", lengths).select("*", numbers).select("*", shifts).where((at >= 0) & (at + size <= n))
    look = look.select("category", "length", "i", F.substring("k", at + 1, size).alias("part"), F.col("seq").alias("other"), F.col("k").alias("other_k"))
    met = cut.join(look, ["category", "length", "i", "part"])
    short = rows.where(n < parts)
    near = rows.where(n < parts + most).select("category", F.col("seq").alias("other"), F.col("k").alias("other_k"))
    met = met.select("seq", "k", "other", "other_k").unionByName(short.join(near, "category").select("seq", "k", "other", "other_k"))
    fit = met.where((F.col("seq") != F.col("other")) & (F.levenshtein("k", "other_k", most) >= 0))
    return fit.select(F.least("seq", "other").alias("a"), F.greatest("seq", "other").alias("b")).distinct()


def cluster(tagged: DataFrame, most: int = 2) -> DataFrame:
    """``tagged`` (category, seq, what, ...) with cluster_id.

    In order of seq, a text joins the first leader of its category within ``most``
    edits (in lower case), or leads a new cluster. The leaders are the first
    maximal independent set of the graph of similar texts, found in rounds: a
    text with no undecided one before it leads, and those after it follow. A
    round stores who follows and the edges between those still undecided.
    """
    keyed = tagged.withColumn("k", F.lower("what"))
    distinct = stored(keyed.groupBy("category", "k").agg(F.min("seq").alias("seq")), "texts")
    pairs = stored(similar_texts(distinct, most), "similar")
    edges, followers = pairs, pairs.select(F.col("b").alias("a")).limit(0)
    while edges.limit(1).count():
        lead = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        follow = stored(edges.join(lead, "a", "left_semi").select(F.col("b").alias("a")).distinct(), "follow")
        followers = followers.unionByName(follow)
        # a leader's edges end at followers, so they go with them; who is left without any leads
        edges = stored(edges.join(follow, "a", "left_anti").join(follow.withColumnRenamed("a", "b"), "b", "left_anti"), "edges")
    joined = pairs.join(followers, "a", "left_anti").groupBy(F.col("b").alias("seq")).agg(F.min("a").alias("leader"))
    of = distinct.join(joined, "seq", "left").select("category", "k", F.coalesce("leader", "seq").alias("cluster_id"))
    return keyed.join(of, ["category", "k"]).drop("k")


def cluster_equal(tagged: DataFrame) -> DataFrame:
    """The clusters of ``cluster`` with no edits allowed."""
    return tagged.withColumn("cluster_id", F.min("seq").over(Window.partitionBy("category", F.lower("what"))))


def merge_what(clustered: DataFrame) -> DataFrame:
    """cluster_id, what, n_values: of the trimmed values the shortest (in bytes)
    that two or more say, else the shortest; of equals the first."""
    counts = clustered.groupBy("cluster_id", text.trim_space(F.col("what")).alias("what")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.col("n") >= 2), F.octet_length("what"), "first")
    rows = counts.withColumn("k", F.row_number().over(order)).withColumn("n_values", F.count("*").over(Window.partitionBy("cluster_id")))
    return rows.where("k = 1").select("cluster_id", "what", "n_values")


def _first_seen(clustered: DataFrame, parts: Column, glue: str, name: str) -> DataFrame:
    """Each part of a cluster once, in the order in which they are first seen, joined."""
    rows = clustered.select("cluster_id", "seq", F.posexplode(parts).alias("pos", "part"))
    once = rows.groupBy("cluster_id", "part").agg(F.min(F.struct("seq", "pos")).alias("at"))
    joined = once.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    merged = joined.select("cluster_id", F.array_join(F.transform("parts", lambda x: x["part"]), glue).alias(name))
    return clustered.select("cluster_id").distinct().join(merged, "cluster_id", "left").na.fill("", [name])


def merge_why(clustered: DataFrame) -> DataFrame:
    return _first_seen(clustered, text.sentences(F.col("why")), ". ", "why")


def _steps() -> Column:
    return F.filter(F.transform(text.lines(F.col("how")), text.trim_space), lambda x: x != "")


def merge_how(clustered: DataFrame) -> DataFrame:
    return _first_seen(clustered, _steps(), "\n", "how")


def merge_list(clustered: DataFrame, field: str) -> DataFrame:
    """cluster_id and the sorted union of a list of the context."""
    rows = clustered.select("cluster_id", F.explode(field).alias("x")).distinct()
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list("x")).alias(field))


def merge_parts(clustered: DataFrame, lists: list[str]) -> DataFrame:
    """cluster_id, why, how and ``lists`` as ``merge_why``, ``merge_how`` and ``merge_list`` give them (null where a
    cluster has nothing), in one pass: equal parts of a cluster are one row before they are brought together."""

    def tagged(name: str, parts: Column) -> Column:
        return F.coalesce(F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("field"), i.alias("pos"), x.alias("part"))), F.array())

    each = F.concat(tagged("why", text.sentences(F.col("why"))), tagged("how", _steps()), *(tagged(c, F.col(c)) for c in lists))
    rows = clustered.select("cluster_id", "seq", F.inline(each)).where("part is not null")
    once = rows.groupBy("cluster_id", "field", "part").agg(F.min(F.struct("seq", "pos")).alias("at"))

    def of(name: str, *order: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct(*order, "part"))))
        return F.when(F.size(found) > 0, F.transform(found, lambda x: x["part"]))

    texts = (F.array_join(of(c, "at"), glue).alias(c) for c, glue in (("why", ". "), ("how", "\n")))
    return once.groupBy("cluster_id").agg(*texts, *(of(c).alias(c) for c in lists))


def merge_outcome(clustered: DataFrame) -> DataFrame:
    """cluster_id, key, value (the first), n_values of every outcome."""
    rows = clustered.select("cluster_id", "seq", F.explode("outcome").alias("key", "value"))
    return rows.groupBy("cluster_id", "key").agg(F.min_by("value", "seq").alias("value"), F.countDistinct("value").alias("n_values"))


def merged_outcomes(clustered: DataFrame, votes: DataFrame) -> DataFrame:
    """cluster_id, outcome: each key with its first value, or the winner of a vote on it."""
    place = F.lit(len("context.outcome.") + 1)
    won = votes.where(F.startswith("field", F.lit("context.outcome.")) & F.col("winner").isNotNull()).select("cluster_id", F.substring("field", place, F.lit(1 << 30)).alias("key"), "winner")
    rows = merge_outcome(clustered).join(won, ["cluster_id", "key"], "left")
    return rows.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.coalesce("winner", "value"))))).alias("outcome"))


def conflicts(clustered: DataFrame) -> DataFrame:
    """cluster_id, field, seq, model, value: what is said where a cluster says
    more than one thing about ``what`` or about an outcome."""
    what = clustered.select("cluster_id", F.lit("what").alias("field"), "seq", "model", text.trim_space(F.col("what")).alias("value"))
    rows = what
    if "outcome" in clustered.columns:
        said = clustered.select("cluster_id", "seq", "model", F.explode("outcome").alias("key", "value"))
        rows = what.unionByName(said.select("cluster_id", F.concat(F.lit("context.outcome."), "key").alias("field"), "seq", "model", "value"))
    odd = rows.groupBy("cluster_id", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi")
    return rows.join(odd.select("cluster_id", "field"), ["cluster_id", "field"], "left_semi")


def model_tenths(model: Column) -> Column:
    return rules.weight_of(F.lower(model), rules.MODEL_TENTHS, rules.OTHER_MODEL_TENTHS)


def vote(said: DataFrame) -> DataFrame:
    """How each conflict (cluster_id, field, with seq, model, value) is decided:
    kind, winner, model, tenths.

    Values count by what they are in lower case, each with the weight of its
    model. With enough weight the best is a ``majority``, in its first spelling;
    else, of several values, the first that a model of the highest weight gave
    wins (``highest_weight``); one value alone is ``merged``.
    """
    rows = said.select("cluster_id", "field", "seq", "value", "model", model_tenths(F.col("model")).alias("tenths"), F.lower(text.trim_space(F.col("value"))).alias("norm"))
    sums = rows.groupBy("cluster_id", "field", "norm").agg(F.sum("tenths").alias("tenths"), F.min_by("value", "seq").alias("value"), F.min("seq").alias("first"))
    top = sums.groupBy("cluster_id", "field").agg(F.count("*").alias("n"), F.max(F.struct("tenths", (-F.col("first")).alias("r"), "value")).alias("top"))
    heavy = rows.groupBy("cluster_id", "field").agg(F.max(F.struct("tenths", (-F.col("seq")).alias("r"), "model", "value")).alias("heavy"))
    both = top.join(heavy, ["cluster_id", "field"])
    major = F.col("top.tenths") >= rules.MAJORITY_TENTHS
    kind = F.when(major, "majority").when(F.col("n") > 1, "highest_weight").otherwise("merged")
    return both.select(
        "cluster_id", "field", kind.alias("kind"), F.when(kind == "majority", F.col("top.value")).when(kind == "highest_weight", F.col("heavy.value")).alias("winner"),
        F.when(kind == "highest_weight", F.col("heavy.model")).alias("model"), F.when(kind == "majority", F.col("top.tenths")).when(kind == "highest_weight", F.col("heavy.tenths")).cast("long").alias("tenths"))


def synthesize(clustered: DataFrame) -> DataFrame:
    """One entry per cluster: what, why, how, category, n_entries, and of files, commits,
    dependencies and outcome what ``clustered`` has; ordered by what.

    A cluster of one is as it came. What a vote decided replaces what merging
    picked, within its own cluster; texts are trimmed; the category is that of
    the merged text. Lists are brought together, sorted; of an outcome's values
    the first stays unless a vote decided. Entries and votes are stored once, as
    each is read several times.
    """
    clustered = stored(clustered, "clustered")
    votes = stored(vote(conflicts(clustered)), "votes")
    decided = votes.where("field = 'what'").select("cluster_id", "winner")
    lists = [c for c in ("files", "commits", "dependencies") if c in clustered.columns]
    maps = [c for c in ("outcome",) if c in clustered.columns]
    single = clustered.groupBy("cluster_id").agg(F.count("*").alias("n_entries"), F.first("what").alias("w"), F.first("why").alias("y"), F.first("how").alias("h"), *(F.first(c).alias("__" + c) for c in lists + maps))
    rows = single.join(merge_what(clustered), "cluster_id").join(merge_parts(clustered, lists), "cluster_id", "left").na.fill("", ["why", "how"]).join(decided, "cluster_id", "left")
    alone = F.col("n_entries") == 1
    picked = {"what": F.when(alone, F.col("w")).otherwise(F.coalesce("winner", "what")), "why": F.when(alone, F.col("y")).otherwise(F.col("why")), "how": F.when(alone, F.col("h")).otherwise(F.col("how"))}
    for c in maps:
        rows = rows.join(merged_outcomes(clustered, votes), "cluster_id", "left")
    context = [F.when(alone, F.col("__" + c)).otherwise(F.col(c)).alias(c) for c in lists + maps]
    rows = rows.select("cluster_id", "n_entries", *(text.trim_space(c).alias(n) for n, c in picked.items()), *context)
    return rows.withColumn("category", rules.infer_category(F.col("what"), F.col("why"), F.col("how"))).orderBy("what", "cluster_id")


def report(clustered: DataFrame) -> DataFrame:
    """One row: n_inputs, n_outputs, n_conflicts, n_resolved, n_manual, output_ratio_pct (100 at most), models."""
    ends = clustered.agg(F.count("*").alias("n_inputs"), F.countDistinct("cluster_id").alias("n_outputs"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    votes = vote(conflicts(clustered)).agg(F.struct(F.count("*").alias("n_conflicts"), F.count_if(F.col("kind") != "keep_all").alias("n_resolved"), F.count_if(F.col("kind") == "keep_all").alias("n_manual")))
    pct = F.when(F.col("n_inputs") > 0, F.least(F.lit(100.0), F.col("n_outputs") * 100.0 / F.col("n_inputs"))).otherwise(100.0)
    return ends.withColumn("votes", votes.scalar()).select("*", "votes.*", pct.cast("double").alias("output_ratio_pct")).drop("votes")
