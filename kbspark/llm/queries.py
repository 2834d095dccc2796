"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontaminate, langid, ngram_join, packing, prefix_trie, quality_rules, records, runs, sharding, suffix_dedup, topk, urls, weak_quality
from kbspark.llm.common import stored, table

OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
    END AS rule FROM parts),
listed AS (
  SELECT DISTINCT concat(host, path) AS key FROM parts
  WHERE list_has_any(regexp_split_to_array(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'spam']) OR length(html) - length(replace(html, '%%%', '')) >= 30)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN concat(host, path) IN (SELECT key FROM listed) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

#: Words of a text as a list in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reached AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION
  SELECT reached.doc_id, b FROM reached JOIN links ON a = other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, c), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reached GROUP BY doc_id) USING (doc_id)
"""

OP3_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
hits AS (
  SELECT r, i, n, id
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)))
  JOIN windows USING (n, g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS names FROM (SELECT DISTINCT r, id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN ids USING (r)
"""


def _op7_sql(alpha: float = 0.02, delta: float = 0.05, worth: float = 5.0) -> str:
    rules = quality_rules.RULES
    cutoffs = ", ".join(f"('{rule}', {k}, CAST({c} AS DOUBLE))" for rule, cs in rules for k, c in enumerate(cs))
    x = {"symbol_share": "n_symbols / word_chars", "dup_line_rate": "n_dup_lines / n_words", "repeat_share": "n_repeat_words / n_words", "word_length": "word_chars / n_words", "word_shortness": "n_words / word_chars"}
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {e}" for r, e in x.items()) + " END"
    share = alpha / len(rules)
    tail = f"list_sum(list_transform(range(0, n_false + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({share}) + (n_good - j) * ln(1 - {share}))))"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM documents),
grams AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS k FROM grams) WHERE k > 1) GROUP BY r),
measured AS (
  SELECT r, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM texts LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
rules(rule, k, cutoff) AS (VALUES {cutoffs}),
tests AS (SELECT judged.*, rule, k, cutoff, coalesce({value} > cutoff, false) AS above FROM judged, rules),
known AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT stratum, rule, k, cutoff, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (good = 1 AND above) AS n_false, count(*) FILTER (good <> 1) AS n_bad, count(*) FILTER (good <> 1 AND above) AS n_caught
  FROM tests JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
tails AS (SELECT *, CASE WHEN n_false < n_good * {share} THEN {tail} ELSE 1 END AS p FROM counts),
sure AS (
  SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY k) <= {delta} / ((SELECT greatest(1, count(DISTINCT stratum)) FROM counts) * {len(rules)}) AS is_sure,
    n_caught / greatest(n_bad, 1) - {worth} * (n_false / greatest(n_good, 1)) AS gain
  FROM tails),
chosen AS (SELECT stratum, rule, cutoff FROM sure WHERE is_sure AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, k) = 1),
rejected AS (SELECT DISTINCT r FROM tests JOIN chosen USING (stratum, rule, cutoff) WHERE above)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept
FROM judged
"""


OP11_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM whole q JOIN whole x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v))
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
"""

#: The CRC-32 of a string of digits, unsigned.
_CRC32 = "xor(list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)), CAST(4294967295 AS BIGINT)), 4294967295)"

OP12_SQL = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT conv_id, turn, md5(concat(length(role), ':', role, text)) AS id, strlen(text) AS size FROM turns),
seqs AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(size ORDER BY turn NULLS FIRST, id) AS sizes, {_CRC32.format("conv_id")} % 9 AS h FROM named GROUP BY conv_id),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.ids, [])[1:s.h], s.ids[s.h + 1:]) AS ids, list_concat(coalesce(b.sizes, [])[1:s.h], s.sizes[s.h + 1:]) AS sizes
  FROM seqs s LEFT JOIN seqs b ON b.conv_id = s.conv_id - s.conv_id % 5),
prefixes AS (SELECT conv_id, len(ids) AS n, d, array_to_string(ids[1:d], '') AS k, array_to_string(ids[1:d - 1], '') AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM prefixes GROUP BY k, d),
children AS (SELECT up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
above AS (SELECT substr(k, 1, 32 * unnest(range(0, d + 1))) AS k, saved, CAST(k NOT IN (SELECT k FROM children) AS BIGINT) AS leaf FROM nodes),
sums AS (SELECT k, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY k)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums s ON s.k = x.k LEFT JOIN children c ON c.k = x.k LEFT JOIN nodes p ON x.d > 0 AND p.k = x.up
"""

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, coverage=(1, 20))
    return found.drop("spans")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return records.with_starts(records.read_records(index), index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op6_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: The contract's rules, as (verdict, host, path).
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Parts of host names, between dots or hyphens, that put a host's pages on the list.
LISTED_PARTS = ("ads", "adult", "bets", "casino", "pills", "spam")
#: A page with so many runs of this mark is on the list as well.
MARK, MARKS = "%%%", 10


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list of op9: the keys (host and path) of pages of junk, told by their host's name or by what is in them."""
    host, path = urls.host_and_path(F.col("url"))
    marked = F.char_length("html") - F.char_length(F.replace("html", F.lit(MARK), F.lit(""))) >= MARKS * len(MARK)
    junk = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, LISTED_PARTS))) | F.coalesce(marked, F.lit(False))
    return pages.where(junk).select(F.concat(host, path).alias("key"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, listed_pages(pages), URL_RULES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_on_documents(docs))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _rebuilt(seqs: DataFrame) -> DataFrame:
    """The sequences of op12: each starts with some turns of another conversation, how many tells a checksum of its id."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    size = prefix_trie._ID
    base = seqs.where("conv_id % 5 = 0").select(F.col("conv_id").alias("of"), F.substring("seq", 1, 8 * size).alias("first_seq"), F.slice("sizes", 1, 8).alias("first_sizes"))
    rows = seqs.withColumn("of", F.expr("conv_id - conv_id % 5")).withColumn("h", h.cast("int")).join(base, "of", "left")
    head, tail = F.substring(F.coalesce("first_seq", F.lit(b"")), F.lit(1), F.col("h") * size), F.substring(F.col("seq"), F.col("h") * size + 1, F.lit(2**31 - 1))
    sizes = F.concat(F.slice(F.coalesce("first_sizes", F.expr("CAST(array() AS array<bigint>)")), F.lit(1), F.col("h")), F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes") - F.col("h"), F.lit(0))))
    return rows.select("conv_id", F.concat(head, tail).alias("seq"), sizes.alias("sizes"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = stored(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie_of(_rebuilt(seqs))


def _rewritten(docs: DataFrame) -> DataFrame:
    """The texts of op13: in a tenth of them (by a checksum of the id) the words from some place on repeat a few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    some = docs.where((h % 10 == 0) & F.coalesce(F.size(words) > 0, F.lit(False))).select("doc_id", words.alias("w"), g.alias("g")).withColumn("n", F.size("w").cast("long"))
    some = some.withColumn("a", F.col("g") % n).withColumn("p", F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8)))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    rest = docs.where(F.coalesce((h % 10 != 0) | (F.size(words) == 0), F.lit(True)))
    return rest.select("doc_id", "text").unionByName(some.select("doc_id", text.alias("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_rewritten(table(spark, sf_dir, "documents")), least=12, digest=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op3_benchmark_decontamination": OP3_SQL, "op7_quality_rules": _op7_sql(), "op9_url_filters": OP9_SQL, "op11_exact_top_k": OP11_SQL, "op12_conversation_prefix_trie": OP12_SQL}
