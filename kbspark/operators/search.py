"""Ranked search over knowledge entries, and looking entries up and counting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import rules, text

FIELDS = ("what", "why", "how")


def category_weight(category: Column) -> Column:
    return rules.weight_of(category, rules.CATEGORY_WEIGHTS, rules.OTHER_WEIGHT)


def matches(entries: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Entries with ``query`` in what, why or how, as literal text in any case:
    with matched_fields (in that order) and score (a weight per field that has it,
    however often, and one of the category)."""
    rows = entries if category is None else entries.where(F.col("category") == category)
    hit = {f: text.contains_ignoring_case(F.col(f), query) for f in FIELDS}
    fields = F.filter(F.array(*(F.when(h, f) for f, h in hit.items())), lambda x: x.isNotNull())
    score = category_weight(F.col("category"))
    for f, h in hit.items():
        score = score + F.when(h, rules.FIELD_WEIGHTS[f]).otherwise(0.0)
    return rows.withColumns({"matched_fields": fields, "score": score}).where(F.size("matched_fields") > 0)


def ask(entries: DataFrame, query: str, max_results: int = 10, category: str | None = None) -> DataFrame:
    """The best ``max_results`` entries, by score, then by path."""
    found = matches(entries, query, category).withColumn("file_path", F.concat_ws("/", "category", "file_name"))
    return found.orderBy(F.desc("score"), "file_path").limit(max_results).select("file_path", "category", *FIELDS, "matched_fields", "score")


def get_entry(entries: DataFrame, category: str, name: str) -> DataFrame:
    """The entry of exactly this category and name; no rows if there is none."""
    return entries.where((F.col("category") == category) & (F.col("file_name") == name + ".toml"))


def context_lines(context: Column) -> Column:
    """The non-empty lists of a context as "Label: a, b" lines."""
    line = lambda label, field: F.when(F.size(context[field]) > 0, F.concat(F.lit(label + ": "), F.array_join(context[field], ", ")))
    return F.concat_ws("\n", line("Files", "files"), line("Commits", "commits"), line("Dependencies", "dependencies"))


def list_categories(entries: DataFrame) -> DataFrame:
    """A row for each known category, if only with 0, and ``other`` if there are others; counts at any depth."""
    known = entries.sparkSession.createDataFrame([(c, i) for i, c in enumerate(rules.CATEGORIES)], "category string, place int")
    label = F.when(F.col("category").isin(*rules.CATEGORIES), F.col("category")).otherwise("other")
    counts = entries.groupBy(label.alias("category")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(known), "category", "full").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def status_counts(entries: DataFrame, depth: Column | None = None) -> DataFrame:
    """One row with the count of each known category and their total; only entries directly in the category's folder count."""
    rows = entries if depth is None else entries.where(depth == 1)
    each = {c: F.count_if(F.col("category") == c).alias(c) for c in rules.CATEGORIES}
    return rows.agg(*each.values(), F.count_if(F.col("category").isin(*rules.CATEGORIES)).alias("total"))
