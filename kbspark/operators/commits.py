"""Commit statistics, significance scores, walks and what of them is new.

Scores are computed in whole thousandths, so that class limits hold exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import rules, text


def diff_stats(commits: DataFrame, deltas: DataFrame, under: str | None = None) -> DataFrame:
    """hash, files_changed, insertions, deletions; 0 where nothing is known.
    ``under`` narrows the statistics, not the commits, to paths that start so."""
    rows = deltas if under is None else deltas.where(F.startswith("path", F.lit(under)))
    stats = rows.groupBy("hash").agg(F.count("*").alias("files_changed"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return commits.select("hash").join(stats, "hash", "left").na.fill(0, ["files_changed", "insertions", "deletions"])


def touching(commits: DataFrame, deltas: DataFrame, under: str) -> DataFrame:
    """The commits that change a path that starts with ``under``."""
    return commits.join(deltas.where(F.startswith("path", F.lit(under))).select("hash"), "hash", "left_semi")


def score_class(thousandths: Column) -> Column:
    t = thousandths
    return F.when(t >= 800, "Critical").when(t >= 600, "High").when(t >= 400, "Medium").when(t >= 200, "Low").otherwise("Trivial")


def score_commits(commits: DataFrame, deltas: DataFrame, path_rules: Mapping[str, float] | DataFrame = rules.PATH_RULES, message_rules: Mapping[str, float] | DataFrame = rules.MESSAGE_RULES, weights: Mapping[str, float] = rules.SCORE_WEIGHTS) -> DataFrame:
    """hash, significance (float), category, and the factors: lines and diff_score,
    pattern and pattern_score, keyword and message_score.

    Commits without exactly one parent get 0.5 for diff and pattern, and no such
    factors. A diff of at most one line, or with more than four fifths of its
    files documents, counts half. Of rules of equal weight the first by name is told.
    Rules are a mapping, or a table (token, weight) of any length.
    """
    best_of = lambda c, table: rules.table_rule(table)(c) if isinstance(table, DataFrame) else rules.best_rule(c, table)
    hundredths, token = best_of(F.col("path"), path_rules)
    is_doc = text.extension(F.col("path")).isin(*rules.DOC_EXTENSIONS)
    per_file = deltas.select("hash", "insertions", "deletions", is_doc.alias("is_doc"), hundredths.alias("h"), token.alias("t"))
    best = F.min(F.struct((-F.col("h")).alias("less"), F.col("t").isNull().alias("none"), "t"))
    stats = per_file.groupBy("hash").agg(
        F.sum(F.col("insertions") + F.col("deletions")).alias("lines"), F.count("*").alias("n"), F.count_if("is_doc").alias("docs"), best.alias("best"))
    rows = commits.join(stats, "hash", "left").withColumns({"lines": F.coalesce("lines", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    single = F.col("n_parents") == 1
    trivial = (F.col("lines") <= 1) | ((F.col("n") > 0) & (5 * F.col("docs") > 4 * F.col("n")))
    size = F.when(F.col("lines") <= 10, 10).when(F.col("lines") <= 50, 30).when(F.col("lines") <= 200, 50).when(F.col("lines") <= 500, 70).otherwise(100)
    diff = F.when(~single, 500).when(trivial, size * 5).otherwise(size * 10)  # thousandths
    pattern = F.when(~single, 50).otherwise(F.coalesce(-F.col("best.less"), F.lit(0)))
    words, keyword = best_of(F.lower("message"), message_rules)
    w = {k: round(v * 10) for k, v in weights.items()}
    total = (diff * w["diff"] + pattern * 10 * w["pattern"] + words * 10 * w["message"]) / 10  # thousandths
    rows = rows.select(
        "hash", total.alias("total"), F.when(single, F.col("lines")).alias("lines"), F.when(single, diff / 1000.0).cast("double").alias("diff_score"),
        F.when(single, F.col("best.t")).alias("pattern"), F.when(single & F.col("best.t").isNotNull(), pattern / 100.0).cast("double").alias("pattern_score"),
        keyword.alias("keyword"), F.when(keyword.isNotNull(), words / 100.0).cast("double").alias("message_score"))
    return rows.select("hash", (F.col("total") / 1000).cast("float").alias("significance"), score_class(F.col("total")).alias("category"), "lines", "diff_score", "pattern", "pattern_score", "keyword", "message_score")


def significant(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("category").isin("Critical", "High", "Medium"))


def skip_merges(commits: DataFrame) -> DataFrame:
    return commits.where("n_parents <= 1")


def walk_page(commits: DataFrame, after: int = 0, limit: int | None = None, merges: bool = True) -> DataFrame:
    """The next commits in the order of ``pos`` beyond ``after``: at most ``limit``,
    and after them, with is_next set, the commit of any kind to go on from."""
    rows = commits.where(F.col("pos") > after).withColumn("shown", F.lit(True) if merges else F.col("n_parents") <= 1)
    if limit is None:
        return rows.where("shown").drop("shown").withColumn("is_next", F.lit(False))
    page = rows.where("shown").orderBy("pos").limit(limit)
    end = page.agg(F.coalesce(F.when(F.count("*") == limit, F.max("pos")), F.lit((1 << 62)) if limit else F.lit(after)).alias("end"))
    token = rows.join(F.broadcast(end), F.col("pos") > F.col("end")).orderBy("pos").limit(1).drop("end")
    return page.withColumn("is_next", F.lit(False)).unionByName(token.withColumn("is_next", F.lit(True))).drop("shown")


def unprocessed(commits: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """Commits that the manifest hasn't; all of them with ``full``."""
    return commits if full else commits.join(manifest.select(F.col("sha").alias("hash")), "hash", "left_anti")


def new_prefix(commits: DataFrame, manifest: DataFrame) -> DataFrame:
    """From the newest commit back to, and without, the first processed one; oldest first."""
    done = commits.join(manifest.select(F.col("sha").alias("hash")), "hash", "left_semi").agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))
    return commits.join(F.broadcast(done), F.col("pos") > F.col("last")).drop("last").orderBy("pos")


def commits_since(manifest: DataFrame, sha: str) -> DataFrame:
    """Manifest commits processed after that of ``sha``, in that order; none if it is unknown."""
    point = manifest.where(F.col("sha") == sha).select(F.col("processed_at").alias("point")).limit(1)
    return manifest.join(F.broadcast(point), F.col("processed_at") > F.col("point")).drop("point").orderBy("processed_at")


def commit_counts(commits: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: total (without merges), processed (the manifest's size), unprocessed."""
    plain = skip_merges(commits)
    rest = unprocessed(plain, manifest).agg(F.count("*")).scalar()
    return plain.agg(F.count("*").alias("total")).withColumns({"processed": manifest.agg(F.count("*")).scalar(), "unprocessed": rest})
