"""What has changed since the last run: files against a manifest, and the
patterns and commits that the manifest keeps track of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(files: DataFrame, kb_dir: str = ".kb", path: str = "path") -> DataFrame:
    """Without what lies in, or is called, ``.git`` or the knowledge folder, at any depth."""
    return files.where(~F.col(path).rlike(rf"(^|/)(\.git|{kb_dir.replace('.', chr(92) + '.')})(/|$)"))


def scan_changes(files: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """path, hash, size, status (new, modified, unchanged), is_new, is_changed of
    every file; with ``full`` all count as changed."""
    known = manifest.select("path", F.col("hash").alias("old_hash")).dropDuplicates(["path"])
    rows = files.select("path", "hash", "size").join(known, "path", "left")
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "modified").otherwise("unchanged")
    rows = rows.withColumn("status", status)
    return rows.select("path", "hash", "size", "status", (F.col("status") == "new").alias("is_new"), (F.lit(full) | (F.col("status") == "modified")).alias("is_changed"))


def deleted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths that the manifest has and the scan hasn't."""
    return manifest.select("path").distinct().join(files.select("path"), "path", "left_anti")


def scan_counts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: total, changed, deleted, unchanged; total is changed and unchanged."""
    found = scan_changes(files, manifest).agg(F.count("*").alias("total"), F.count_if(F.col("status") != "unchanged").alias("changed"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))
    return found.withColumn("deleted", deleted(files, manifest).agg(F.count("*")).scalar())


def tracked_changes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest paths whose file is gone or differs; new files are not told."""
    rows = manifest.select("path", "hash").dropDuplicates(["path"]).join(files.select("path", F.col("hash").alias("now")), "path", "left")
    return rows.where(F.col("now").isNull() | (F.col("now") != F.col("hash"))).select("path", F.col("now").isNull().alias("is_missing"))


def manifest_stats(files: DataFrame, commits: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: n_files, n_commits, n_patterns, last_scan (null without files)."""
    counts = files.agg(F.count("*").alias("n_files"), F.max("scanned").alias("last_scan"))
    return counts.withColumns({"n_commits": commits.agg(F.count("*")).scalar(), "n_patterns": patterns.agg(F.count("*")).scalar()})


def invalidated_patterns(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Patterns of the manifest to which a modified or deleted file has contributed, in order."""
    modified = scan_changes(files, manifest).where("status = 'modified'").select("path")
    gone = modified.unionByName(deleted(files, manifest))
    return manifest.join(gone, "path", "left_semi").where("pattern_id is not null").select("pattern_id").distinct().orderBy("pattern_id")


def pattern_files(patterns: DataFrame, pattern_paths: DataFrame, files: DataFrame) -> DataFrame:
    """The existing files that contribute to ``patterns``, as they are now, as changed but not new."""
    paths = pattern_paths.join(patterns.select("pattern_id"), "pattern_id", "left_semi").select("path").distinct()
    return files.join(paths, "path", "left_semi").select("path", "hash", "size", F.lit(False).alias("is_new"), F.lit(True).alias("is_changed"))


def link_patterns(links: DataFrame, new: DataFrame, patterns: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` (pattern_id, path) and those of ``new`` whose both ends exist, each once."""
    fit = new.join(patterns.select("pattern_id"), "pattern_id", "left_semi").join(files.select("path"), "path", "left_semi")
    return links.select("pattern_id", "path").unionByName(fit.select("pattern_id", "path")).distinct()


def latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert by ``key``: of all rows of a key the one with the greatest ``order``, of equals that of ``new``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order)))
    return both.withColumn("__k", rank).where("__k = 1").drop("__k", "__new")


def lookup(manifest: DataFrame, value: Column | str, key: str = "path") -> DataFrame:
    """The manifest's row of exactly this path (or other ``key``); no rows if there is none."""
    return manifest.where(F.col(key) == value)


def removed(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def touched(patterns: DataFrame, invalid: DataFrame, now: Column) -> DataFrame:
    """``patterns`` with last_updated set to ``now`` for the ids in ``invalid``."""
    hit = invalid.select("pattern_id", F.lit(True).alias("__hit")).dropDuplicates(["pattern_id"])
    return patterns.join(hit, "pattern_id", "left").withColumn("last_updated", F.when(F.col("__hit"), now).otherwise(F.col("last_updated"))).drop("__hit")
