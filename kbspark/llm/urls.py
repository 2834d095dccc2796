"""URL filters: prefix rules, then exact membership by a Bloom filter cascade.

The cascade's first level encodes the listed keys. Of all other keys of the
corpus, those that pass it by mistake are encoded in the second level; the
listed keys that pass the second by mistake in the third, and so on until a
level lets nothing wrong through. As all keys of the corpus took part, the
first level that a key fails tells exactly whether it is listed, and rows are
judged without a join: each level is one array of bits, read by a scalar
subquery.

An array has to stay small whatever the corpus. So keys are dealt to slices by
a hash, as many as it takes to hold a level in about ``max_bits`` bits, and each
slice has a cascade of its own, which judges that slice's rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)\\z", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path in one string, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


class Cascade:
    """Filters of alternating levels."""

    def __init__(self, hashes: int):
        self.hashes, self.levels = hashes, []

    def passes(self, key: Column, level: int) -> Column:
        bits, words = self.levels[level]
        word = words.scalar()
        for i in range(self.hashes):
            h = F.xxhash64(key, F.lit(level), F.lit(i)).bitwiseAND(F.lit(bits - 1))
            set_bit = F.get(word, F.shiftright(h, 6).cast("int")).bitwiseAND(_one_bit(h)) != 0
            found = found & set_bit if i else set_bit
        return found

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            verdict = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(verdict)
        return verdict


def _one_bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _filter(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row with the level's bits as an array of 64-bit words, put together from arrays of 1024."""
    at = F.explode(F.array(*(F.xxhash64("key", F.lit(level), F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)))).alias("at")
    words = keys.select(at).select(F.shiftright("at", 6).alias("word"), _one_bit(F.col("at")).alias("v"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("v"))
    merged = words.unionByName(blank).groupBy("word").agg(F.bit_or("v").alias("v"))
    in_order = lambda place, value: F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value])
    chunks = merged.groupBy(F.shiftright("word", 10).alias("chunk")).agg(in_order("word", "v").alias("vs"))
    return chunks.agg(F.flatten(in_order("chunk", "vs")).alias("words"))  # bits / 64 numbers


def build_cascade(universe: DataFrame, bits_per_key: int = 8, hashes: int = 4) -> Cascade:
    """The cascade over ``universe`` (distinct key, listed)."""
    cascade = Cascade(hashes)
    encode = universe.where("listed").select("key")
    test = universe.where(~F.col("listed")).select("key")
    n = encode.count()
    while n:
        level, bits = len(cascade.levels), 64
        while bits < n * bits_per_key:
            bits *= 2
        cascade.levels.append((bits, stored(_filter(encode, level, bits, hashes), f"level{level}")))
        wrong = stored(test.where(cascade.passes(F.col("key"), level)), f"wrong{level}")
        encode, test, n = wrong, encode, wrong.count()
    return cascade


def slices_for(n_listed: int, n_other: int, bits_per_key: int, hashes: int, max_bits: int) -> int:
    """Into how many slices to deal keys, so that neither the listed keys nor those
    expected to pass the first level by mistake need more than ``max_bits`` bits."""
    mistaken = (1 - math.exp(-hashes / bits_per_key)) ** hashes * n_other if n_listed else 0
    return max(1, math.ceil(max(n_listed, mistaken) * bits_per_key / max_bits))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", bits_per_key: int = 8, hashes: int = 4, max_bits: int = 1 << 27) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``listed`` (key) has the keys, host and path in one string, of pages to block
    where no rule fits; null keys and those that no page has do no harm. A null
    url or one without ``://`` has an empty host and path. Repeated rows and null
    ids are judged as any other; an empty table gives no rows; further columns
    are left out.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    of_pages = rows.select(key.alias("key"), F.lit(False).alias("listed"))
    universe = stored(of_pages.unionByName(listed.where("key is not null").select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    n_listed = universe.where("listed").count()
    n = slices_for(n_listed, universe.count() - n_listed, bits_per_key, hashes, max_bits)

    def judged(part: DataFrame, keys: DataFrame) -> DataFrame:
        rule, says = rule_column(F.col("host"), F.col("path"), rules)
        method = F.when(build_cascade(keys, bits_per_key, hashes).listed(key), "block").otherwise("allow")
        return part.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"))

    if n == 1:
        return judged(rows, universe)
    of = lambda k: F.pmod(F.xxhash64(k, F.lit("slice")), F.lit(n))
    rows = stored(rows.withColumn("slice", of(key)), "rows", partition_by="slice")
    universe = stored(universe.withColumn("slice", of(F.col("key"))), "slices", partition_by="slice")
    return reduce(DataFrame.unionByName, (judged(rows.where(F.col("slice") == k), universe.where(F.col("slice") == k)) for k in range(n)))
