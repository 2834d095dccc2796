"""Views that let the driver's tables stand in for a code base.

The same SQL runs in Spark and in DuckDB, apart from the names of two functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations")

VIEWS = {
    "entries": """
SELECT doc_id AS seq, CASE doc_id % 6 WHEN 0 THEN 'decisions' WHEN 1 THEN 'patterns' WHEN 2 THEN 'bugs' WHEN 3 THEN 'migrations' WHEN 4 THEN 'facts' ELSE 'misc' END AS category,
  concat('doc-', CAST(doc_id AS STRING), '.toml') AS file_name, split_part(text, chr(10), 1) AS what, concat(source, ' ', lang) AS why, text AS how
FROM documents""",
    "files_now": """
SELECT concat(lang, '/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, SHA(text) AS hash, CAST(BYTES(text) AS BIGINT) AS size, text
FROM documents WHERE doc_id % 10 <> 9""",
    "manifest_files": """
SELECT concat(lang, '/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, CASE WHEN doc_id % 7 = 0 THEN SHA('stale') ELSE SHA(text) END AS hash,
  concat('p', CAST(doc_id % 13 AS STRING)) AS pattern_id, doc_id AS scanned
FROM documents WHERE doc_id % 4 <> 0""",
    "commits": """
SELECT SHA(CAST(o_orderkey AS STRING)) AS hash, o_orderkey AS pos, o_orderkey AS okey,
  concat(o_orderpriority, chr(10), 'status ', o_orderstatus) AS message,
  CASE WHEN o_orderkey % 17 = 0 THEN 2 WHEN o_orderkey % 19 = 0 THEN 0 ELSE 1 END AS n_parents
FROM orders""",
    "deltas": """
SELECT SHA(CAST(l_orderkey AS STRING)) AS hash, concat(p_type, '/', p_name, '.', CASE l_linenumber % 3 WHEN 0 THEN 'md' ELSE 'py' END) AS path,
  CAST(floor(l_quantity) AS BIGINT) AS insertions, CAST(l_linenumber * 7 AS BIGINT) AS deletions
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # runs of up to 64 commits that branch off earlier ones, merges, and several roots
    "history": """
SELECT SHA(CAST(k AS STRING)) AS hash, SHA(CAST(p1 AS STRING)) AS parent1, SHA(CAST(p2 AS STRING)) AS parent2, day AS timestamp
FROM (SELECT o_orderkey AS k, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS day,
  CASE WHEN o_orderkey % 997 = 0 THEN NULL WHEN o_orderkey % 64 <> 0 THEN o_orderkey - 1 ELSE CAST(floor(o_orderkey / 2) AS BIGINT) END AS p1,
  CASE WHEN o_orderkey % 17 = 0 AND o_orderkey > 0 THEN CAST(floor(o_orderkey / 3) AS BIGINT) END AS p2 FROM orders)""",
    "manifest_commits": """
SELECT SHA(CAST(o_orderkey AS STRING)) AS sha, o_orderkey AS processed_at FROM orders WHERE o_orderkey % 3 = 0""",
    "dated_commits": """
SELECT SHA(CAST(o_orderkey AS STRING)) AS hash, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)) * 10000000000 + o_orderkey AS pos
FROM orders""",
    # what a run at the turn of the year has processed
    "dated_manifest": """
SELECT SHA(CAST(o_orderkey AS STRING)) AS sha FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01 00:00:00'""",
    "authors": """
SELECT SHA(CAST(o_orderkey AS STRING)) AS hash, CASE WHEN c_nationkey % 6 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN concat(c_mktsegment, '@example.org') END AS email
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "tagged": """
SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'gemini' ELSE 'codex' END AS model,
  concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN ' x' ELSE ' extra' END) AS what,
  concat(p_type, ' grade. ', p_brand, ' line') AS why, concat('use ', p_type, chr(10), 'check ', p_brand) AS how, CAST(p_size AS STRING) AS outcome_size, p_brand AS file
FROM part""",
    "replies": """
SELECT event_id AS seq, CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'gemini' ELSE 'codex' END AS model,
  CASE event_type WHEN 'error' THEN NULL ELSE props END AS response,
  CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 5 = 0 THEN concat('HTTP 429, retry after ', CAST(event_id % 90 AS STRING), ' seconds')
    WHEN event_id % 5 = 1 THEN 'Unauthorized' WHEN event_id % 5 = 2 THEN 'service Unavailable' ELSE 'broken pipe' END AS error
FROM events""",
}

# Rules that occur in the driver's tables.
MESSAGE_RULES = {"urgent": 1.0, "high": 0.8, "medium": 0.6, "low": 0.2}
PATH_RULES = {"PROMO/": 1.0, "STANDARD/": 0.8, "LARGE/": 0.5, "SMALL/": 0.3, "ECONOMY/": 0.1}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("SHA(", "sha2_256(").replace("BYTES(", "octet_length(")
    sql = sql.replace("sha2_256(text)", "sha2(text, 256)").replace("sha2_256('stale')", "sha2('stale', 256)")
    for key in ("o_orderkey", "l_orderkey", "k", "p1", "p2"):
        sql = sql.replace(f"sha2_256(CAST({key} AS STRING))", f"sha2(CAST({key} AS STRING), 256)")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **used)


def duck(*names: str) -> str:
    """``WITH`` clause of the named views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace('SHA(', 'sha256(').replace('BYTES(', 'strlen(').replace(' STRING)', ' VARCHAR)')})" for n in names)
