"""Checking, normalising and storing knowledge entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import rules, text


def validate(entries: DataFrame) -> DataFrame:
    """Add error: the first of what, why, how that is blank, else null."""
    error = F.lit(None).cast("string")
    for f in ("how", "why", "what"):
        error = F.when(text.is_blank(F.col(f)), f"{f} is empty").otherwise(error)
    return entries.withColumn("error", error)


def normalize(entries: DataFrame) -> DataFrame:
    """Texts trimmed, the context's lists sorted and without repetitions; outcomes stay."""
    plain = {f: text.trim_space(F.col(f)) for f in ("what", "why", "how")}
    lists = {f: F.array_sort(F.array_distinct(F.col(f))) for f in ("files", "commits", "dependencies") if f in entries.columns}
    return entries.withColumns(plain | lists)


def with_category(entries: DataFrame) -> DataFrame:
    return entries.withColumn("category", rules.infer_category(F.col("what"), F.col("why"), F.col("how")))


def keyed(entries: DataFrame) -> DataFrame:
    """Add the key under which an entry is stored: the category of its text and the slug of what it says."""
    return with_category(entries).withColumn("slug", text.slugify(F.col("what")))


CONTEXT = ("files", "commits", "dependencies", "outcome")


def appended(entries: DataFrame, files: Column | None = None, commits: Column | None = None, dependencies: Column | None = None, outcome: dict[str, Column] | None = None) -> DataFrame:
    """``entries`` with one more item at the end of these lists, and further outcomes, of which a new
    value takes a known key's place; null items and values add nothing."""
    out = {}
    for name, item in (("files", files), ("commits", commits), ("dependencies", dependencies)):
        if item is not None:
            out[name] = F.concat(F.coalesce(F.col(name), F.array().cast("array<string>")), F.when(item.isNotNull(), F.array(item)).otherwise(F.array().cast("array<string>")))
    if outcome:
        have, new = F.coalesce(F.col("outcome"), F.create_map().cast("map<string,string>")), F.create_map(*(c for k, v in outcome.items() for c in (F.lit(k), v)))
        new = F.map_filter(new, lambda _, v: v.isNotNull())
        out["outcome"] = F.map_concat(F.map_filter(have, lambda k, _: ~F.map_contains_key(new, k)), new)
    return entries.withColumns(out)


def body_hash(df: DataFrame):
    """A hash of all that an entry says: its texts and whichever parts of a context ``df`` has."""
    context = [F.array_sort(F.map_entries("outcome")).alias(c) if c == "outcome" else F.col(c) for c in CONTEXT if c in df.columns]
    return F.sha2(F.to_json(F.struct("what", "why", "how", *context), {"ignoreNullFields": "false"}), 256)


def write_actions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """What writing ``batch`` (seq, category, slug, what, why, how and parts of a
    context) in the order of seq does to ``stored`` (category, slug, body; a null body is one that can't
    be read): ``action`` is written, updated or skipped for every row.

    A row meets what the row of the same key before it in the batch left, or
    else what is stored.
    """
    in_key = Window.partitionBy("category", "slug").orderBy("seq")
    old = stored.select("category", "slug", F.col("body").alias("old_body"))
    rows = body_of(batch).join(old, ["category", "slug"], "left")
    met = F.coalesce(F.lag("body").over(in_key), F.col("old_body"))
    action = F.when(met.isNull(), "written").when(met == F.col("body"), "skipped").otherwise("updated")
    return rows.select(*batch.columns, "body", action.alias("action"))


def body_of(entries: DataFrame) -> DataFrame:
    return entries.withColumn("body", body_hash(entries))


def last_of_each_key(batch: DataFrame) -> DataFrame:
    """The row of each key that stays after a batch was written: its last."""
    order = Window.partitionBy("category", "slug").orderBy(F.desc("seq"))
    return batch.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def upsert(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("category", "slug")) -> DataFrame:
    """``stored`` without the keys of ``batch``, and ``batch``. Write it to a new
    version (see kbspark.sources.store), never over what it reads."""
    rest = stored.join(batch.select(*keys), list(keys), "left_anti")
    return rest.unionByName(batch, allowMissingColumns=True)
