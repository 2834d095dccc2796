"""The registered queries over the reference operators, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.adapters import MESSAGE_RULES, PATH_RULES, duck, view
from kbspark.functions import replies, rules, text
from kbspark.operators import changes, commits, entries, history, ignored, line_diff, prompts, search, synthesis
from kbspark.operators.search_index import SearchIndex
from kbspark.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- search ---------------------------------------------------------------

_WEIGHT = "CASE category WHEN 'decisions' THEN 3.0 WHEN 'patterns' THEN 2.5 WHEN 'bugs' THEN 2.0 WHEN 'migrations' THEN 1.5 WHEN 'facts' THEN 1.0 ELSE 0.5 END"


def _found(q: str, where: str = "true") -> str:
    hit = lambda f: f"contains(lower({f}), lower('{q}'))"
    fields = "concat_ws(',', " + ", ".join(f"CASE WHEN {hit(f)} THEN '{f}' END" for f in ("what", "why", "how")) + ")"
    score = f"CAST({_WEIGHT} AS DOUBLE) + " + " + ".join(f"CASE WHEN {hit(f)} THEN {w} ELSE 0 END" for f, w in (("what", 10), ("why", 5), ("how", 3)))
    return f"SELECT concat(category, '/', file_name) AS file_path, seq, category, what, why, how, {fields} AS matched_fields, CAST({score} AS DOUBLE) AS score FROM entries WHERE ({where}) AND ({' OR '.join(hit(f) for f in ('what', 'why', 'how'))})"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("matched_fields", F.array_join("matched_fields", ","))


@query(f"{duck('entries')} SELECT file_path, category, what, why, how, matched_fields, score FROM ({_found('Heen')}) ORDER BY score DESC, file_path LIMIT 10")
def ask_topk(spark, sf_dir):
    return _joined(search.ask(view(spark, sf_dir, "entries"), "Heen"))


_BUGS = "category = 'bugs'"


@query(f"{duck('entries')} SELECT file_path, category, what, why, how, matched_fields, score FROM ({_found('src1', _BUGS)}) ORDER BY score DESC, file_path LIMIT 25")
def ask_category(spark, sf_dir):
    return _joined(search.ask(view(spark, sf_dir, "entries"), "src1", max_results=25, category="bugs"))


@query(f"{duck('entries')} SELECT seq, matched_fields, score FROM ({_found('en')})")
def ask_fields(spark, sf_dir):
    return _joined(search.matches(view(spark, sf_dir, "entries"), "en")).select("seq", "matched_fields", "score")


def _indexed(spark, sf_dir) -> SearchIndex:
    """An index of all entries: first with other texts for a third of them, which an upsert then brings up to date."""
    index, e = SearchIndex(spark, f"{shared_dir(spark)}/kbspark/{uuid.uuid4().hex}-index"), view(spark, sf_dir, "entries")
    late = F.col("seq") % 3 == 0
    index.upsert(e.withColumn("how", F.when(late, F.lit("not Heen yet")).otherwise(F.col("how"))))
    index.upsert(e.where(late))
    return index


@query(f"{duck('entries')} SELECT file_path, category, what, why, how, matched_fields, score FROM ({_found('heenbl')}) ORDER BY score DESC, file_path LIMIT 1000")
def ask_indexed(spark, sf_dir):
    return _joined(_indexed(spark, sf_dir).ask("heenbl", max_results=1000))


@query(f"""{duck('entries')}, counts AS (SELECT CASE WHEN category IN ('decisions','migrations','bugs','patterns','facts') THEN category ELSE 'other' END AS category, count(*) AS n FROM entries GROUP BY 1),
known AS (SELECT unnest(['decisions','migrations','bugs','patterns','facts']) AS category)
SELECT coalesce(k.category, c.category) AS category, CAST(coalesce(n, 0) AS BIGINT) AS n FROM known k FULL JOIN counts c ON k.category = c.category""")
def list_categories(spark, sf_dir):
    return search.list_categories(view(spark, sf_dir, "entries"))


@query(f"""{duck('entries')} SELECT count(*) FILTER (category = 'decisions') AS decisions, count(*) FILTER (category = 'migrations') AS migrations, count(*) FILTER (category = 'bugs') AS bugs,
count(*) FILTER (category = 'patterns') AS patterns, count(*) FILTER (category = 'facts') AS facts, count(*) FILTER (category <> 'misc') AS total FROM entries""")
def status_counts(spark, sf_dir):
    return search.status_counts(view(spark, sf_dir, "entries"))


@query(f"{duck('entries')} SELECT seq, what, why, how FROM entries WHERE category = 'bugs' AND file_name = 'doc-2.toml'")
def get_entry(spark, sf_dir):
    return search.get_entry(view(spark, sf_dir, "entries"), "bugs", "doc-2").select("seq", "what", "why", "how")


@query(f"""{duck('entries')} SELECT seq, category, CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] ELSE 'unknown' END AS dir, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS extension
FROM (SELECT seq, category, concat(category, '/', file_name) AS path FROM entries)""")
def entry_paths(spark, sf_dir):
    path = F.concat_ws("/", "category", "file_name")
    return view(spark, sf_dir, "entries").select("seq", "category", text.parent_dir(path).alias("dir"), text.extension(path).alias("extension"))


# -- entries --------------------------------------------------------------


def _inferred(what: str, why: str, how: str) -> str:
    t = f"lower(concat_ws(' ', {what}, {why}, {how}))"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({t}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{c}'" for c, words in rules.ENTRY_WORDS) + " ELSE 'facts' END"


@query(f"{duck('tagged')} SELECT seq, {_inferred('what', 'why', 'how')} AS category FROM tagged UNION ALL SELECT -1 - doc_id, {_inferred('source', 'lang', 'text')} FROM documents")
def infer_category(spark, sf_dir):
    tagged = entries.with_category(view(spark, sf_dir, "tagged")).select("seq", "category")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((-1 - F.col("doc_id")).alias("seq"), rules.infer_category(F.col("source"), F.col("lang"), F.col("text")).alias("category"))
    return tagged.unionByName(docs)


_BLANKED = "SELECT seq, CASE WHEN seq % 11 = 0 THEN '  ' ELSE what END AS what, CASE WHEN seq % 7 = 0 THEN NULL ELSE why END AS why, CASE WHEN seq % 5 = 0 THEN chr(9) ELSE how END AS how FROM entries"


@query(rf"""{duck('entries')}, e AS ({_BLANKED}) SELECT seq, CASE WHEN NOT regexp_matches(coalesce(what, ''), '\S') THEN 'what is empty' WHEN NOT regexp_matches(coalesce(why, ''), '\S') THEN 'why is empty'
WHEN NOT regexp_matches(coalesce(how, ''), '\S') THEN 'how is empty' END AS error FROM e""")
def validate(spark, sf_dir):
    e = spark.sql(_BLANKED.replace("FROM entries", "FROM {entries}"), entries=view(spark, sf_dir, "entries"))
    return entries.validate(e).select("seq", "error")


_PLAIN = "regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _slug(c: str) -> str:
    p = _PLAIN.format(c)
    return f"CASE WHEN length({p}) > 50 THEN regexp_replace(CASE WHEN contains(left({p}, 50), '-') THEN regexp_extract(left({p}, 50), '^(.*)-[^-]*$', 1) ELSE left({p}, 50) END, '-+$', '') ELSE {p} END"


@query(f"{duck('entries')} SELECT seq, {_slug('what')} AS slug FROM entries")
def slugify(spark, sf_dir):
    return view(spark, sf_dir, "entries").select("seq", text.slugify(F.col("what")).alias("slug"))


# A key's batch has up to three rows. Keys of every fifth block of seq are new ones, those of every seventh
# are met by no row of the batch, and every third block says the same in all its rows.
_BLOCK = "CAST(floor(seq / 18) AS BIGINT)"
_SAID = f"CASE WHEN {_BLOCK} % 3 = 0 THEN category ELSE coalesce(what, '') END"
_BATCH = f"SELECT seq, category, concat(CASE WHEN {_BLOCK} % 5 = 0 THEN 'new' ELSE 's' END, CAST({_BLOCK} AS STRING)) AS slug, {_SAID} AS what, CASE WHEN seq % 3 = 0 THEN 'a' ELSE 'b' END AS why, '' AS how FROM entries"
_STORED = f"SELECT category, concat(CASE WHEN {_BLOCK} % 7 = 0 THEN 'old' ELSE 's' END, CAST({_BLOCK} AS STRING)) AS slug, min_by({_SAID}, seq) AS what, 'a' AS why, '' AS how, min(seq) AS seq FROM entries GROUP BY 1, 2"


def _batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = view(spark, sf_dir, "entries")
    stored = spark.sql(_STORED.replace("FROM entries", "FROM {entries}"), entries=e)
    return spark.sql(_BATCH.replace("FROM entries", "FROM {entries}"), entries=e), entries.body_of(stored).select("category", "slug", F.when(F.col("seq") % 10 != 0, F.col("body")).alias("body"))


@query(f"""{duck('entries')}, b AS ({_BATCH.replace('STRING', 'VARCHAR')}), s AS (SELECT category, slug, CASE WHEN seq % 10 <> 0 THEN concat(what, chr(1), why) END AS old FROM ({_STORED.replace('STRING', 'VARCHAR')})),
m AS (SELECT b.*, concat(what, chr(1), why) AS body, coalesce(lag(concat(what, chr(1), why)) OVER (PARTITION BY b.category, b.slug ORDER BY seq), old) AS met FROM b LEFT JOIN s ON b.category = s.category AND b.slug = s.slug)
SELECT seq, CASE WHEN met IS NULL THEN 'written' WHEN met = body THEN 'skipped' ELSE 'updated' END AS action FROM m""")
def write_actions(spark, sf_dir):
    return entries.write_actions(*_batch(spark, sf_dir)).select("seq", "action")


@query(f"{duck('entries')}, b AS ({_BATCH.replace('STRING', 'VARCHAR')}) SELECT category, slug, max(seq) AS seq FROM b GROUP BY 1, 2")
def write_last_wins(spark, sf_dir):
    return entries.last_of_each_key(_batch(spark, sf_dir)[0]).select("category", "slug", "seq")


@query(f"""{duck('entries')}, b AS (SELECT category, slug, max_by(why, seq) AS why FROM ({_BATCH.replace('STRING', 'VARCHAR')}) GROUP BY 1, 2),
s AS (SELECT category, slug, why FROM ({_STORED.replace('STRING', 'VARCHAR')}) )
SELECT * FROM b UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.category = s.category AND b.slug = s.slug)""")
def upsert_entries(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    stored = spark.sql(_STORED.replace("FROM entries", "FROM {entries}"), entries=e).select("category", "slug", "why")
    return entries.upsert(stored, entries.last_of_each_key(_batch(spark, sf_dir)[0]).select("category", "slug", "why"))


@query(rf"""{duck('entries')} SELECT seq, regexp_replace(concat('  ', what, chr(9)), '^\s+|\s+$', '', 'g') AS what, list_aggregate(list_sort(list_distinct(string_split(why, ' '))), 'string_agg', ',') AS files FROM entries""")
def normalize_entries(spark, sf_dir):
    e = view(spark, sf_dir, "entries").withColumns({"what": F.concat(F.lit("  "), "what", F.lit("\t")), "files": F.split("why", " ")})
    return entries.normalize(e).select("seq", "what", F.array_join("files", ",").alias("files"))


@query(f"""{duck('entries')} SELECT seq, concat('{{"seq":', seq, ',"category":"', category, '","why":"', why, '"}}') AS json FROM entries""")
def entry_json(spark, sf_dir):
    return view(spark, sf_dir, "entries").select("seq", F.to_json(F.struct("seq", "category", "why")).alias("json"))


# -- files and manifest ---------------------------------------------------

_SCAN = """scan AS (SELECT f.path, f.hash, f.size, CASE WHEN m.hash IS NULL THEN 'new' WHEN m.hash <> f.hash THEN 'modified' ELSE 'unchanged' END AS status
FROM files_now f LEFT JOIN (SELECT DISTINCT path, hash FROM manifest_files) m ON f.path = m.path)"""
_GONE = "gone AS (SELECT DISTINCT path FROM manifest_files WHERE path NOT IN (SELECT path FROM files_now))"
_FILES = duck("files_now", "manifest_files")


def _files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "files_now"), view(spark, sf_dir, "manifest_files")


@query(f"{_FILES}, {_SCAN} SELECT *, status = 'new' AS is_new, status = 'modified' AS is_changed FROM scan")
def scan_changes(spark, sf_dir):
    return changes.scan_changes(*_files(spark, sf_dir))


@query(f"{_FILES}, {_SCAN} SELECT *, status = 'new' AS is_new, true AS is_changed FROM scan")
def scan_full(spark, sf_dir):
    return changes.scan_changes(*_files(spark, sf_dir), full=True)


@query(f"{_FILES}, {_GONE} SELECT * FROM gone")
def scan_deleted(spark, sf_dir):
    return changes.deleted(*_files(spark, sf_dir))


@query(f"{_FILES}, {_SCAN}, {_GONE} SELECT count(*) AS total, count(*) FILTER (status <> 'unchanged') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, (SELECT count(*) FROM gone) AS deleted FROM scan")
def scan_counts(spark, sf_dir):
    return changes.scan_counts(*_files(spark, sf_dir))


@query(f"{_FILES}, {_SCAN}, {_GONE} SELECT (SELECT count(*) FROM scan WHERE status <> 'unchanged') + (SELECT count(*) FROM gone) = 0 AS up_to_date")
def up_to_date(spark, sf_dir):
    return changes.scan_counts(*_files(spark, sf_dir)).select(((F.col("changed") == 0) & (F.col("deleted") == 0)).alias("up_to_date"))


@query(f"{_FILES} SELECT DISTINCT m.path, f.hash IS NULL AS is_missing FROM manifest_files m LEFT JOIN files_now f ON m.path = f.path WHERE f.hash IS NULL OR f.hash <> m.hash")
def file_changes_tracked(spark, sf_dir):
    return changes.tracked_changes(*_files(spark, sf_dir))


@query(f"{_FILES} SELECT path FROM files_now WHERE NOT regexp_matches(path, '(^|/)(\\.git|src1)(/|$)')")
def visible_files(spark, sf_dir):
    return changes.visible(view(spark, sf_dir, "files_now"), kb_dir="src1").select("path")


@query(f"{duck('manifest_files', 'manifest_commits')} SELECT (SELECT count(*) FROM manifest_files) AS n_files, (SELECT max(scanned) FROM manifest_files) AS last_scan, (SELECT count(*) FROM manifest_commits) AS n_commits, (SELECT count(DISTINCT pattern_id) FROM manifest_files) AS n_patterns")
def manifest_stats(spark, sf_dir):
    m = view(spark, sf_dir, "manifest_files")
    return changes.manifest_stats(m, view(spark, sf_dir, "manifest_commits"), m.select("pattern_id").distinct())


_INVALID = "invalid AS (SELECT DISTINCT pattern_id FROM manifest_files WHERE path IN (SELECT path FROM scan WHERE status = 'modified' UNION ALL SELECT path FROM gone))"


@query(f"{_FILES}, {_SCAN}, {_GONE}, {_INVALID} SELECT * FROM invalid")
def invalidated_patterns(spark, sf_dir):
    return changes.invalidated_patterns(*_files(spark, sf_dir))


@query(f"{_FILES} SELECT path, hash, size, false AS is_new, true AS is_changed FROM files_now WHERE path IN (SELECT path FROM manifest_files WHERE pattern_id IN ('p3', 'p7'))")
def pattern_files(spark, sf_dir):
    files, m = _files(spark, sf_dir)
    return changes.pattern_files(m.select("pattern_id").where("pattern_id IN ('p3', 'p7')").distinct(), m, files)


_NEW_LINKS = "SELECT concat('p', CAST(size % 17 AS STRING)) AS pattern_id, path FROM files_now"


@query(f"""{_FILES}, n AS ({_NEW_LINKS.replace('STRING', 'VARCHAR')}) SELECT pattern_id, path FROM manifest_files UNION SELECT pattern_id, path FROM n
WHERE pattern_id IN (SELECT pattern_id FROM manifest_files) AND path IN (SELECT path FROM manifest_files)""")
def link_patterns(spark, sf_dir):
    files, m = _files(spark, sf_dir)
    new = spark.sql(_NEW_LINKS.replace("FROM files_now", "FROM {files_now}"), files_now=files)
    return changes.link_patterns(m, new, m.select("pattern_id").distinct(), m.select("path").distinct())


@query(f"{_FILES} SELECT coalesce(f.path, m.path) AS path, coalesce(f.hash, m.hash) AS hash, CASE WHEN f.path IS NULL THEN m.scanned ELSE 1000000 END AS scanned FROM files_now f FULL JOIN manifest_files m ON f.path = m.path")
def manifest_upsert(spark, sf_dir):
    files, m = _files(spark, sf_dir)
    return changes.latest(m.select("path", "hash", "scanned"), files.select("path", "hash", F.lit(1000000).cast("long").alias("scanned")), "path", "scanned")


@query(f"{_FILES}, {_GONE} SELECT path, hash FROM manifest_files WHERE path NOT IN (SELECT path FROM gone)")
def manifest_remove(spark, sf_dir):
    files, m = _files(spark, sf_dir)
    return changes.removed(m.select("path", "hash"), changes.deleted(files, m), "path")


@query(f"""{_FILES}, {_SCAN}, {_GONE}, {_INVALID}, p AS (SELECT pattern_id, max(scanned) AS last_updated FROM manifest_files GROUP BY 1)
SELECT p.pattern_id, CASE WHEN i.pattern_id IS NULL THEN last_updated ELSE 1000000 END AS last_updated FROM p LEFT JOIN invalid i ON p.pattern_id = i.pattern_id""")
def touch_patterns(spark, sf_dir):
    files, m = _files(spark, sf_dir)
    patterns = m.groupBy("pattern_id").agg(F.max("scanned").alias("last_updated"))
    return changes.touched(patterns, changes.invalidated_patterns(files, m), F.lit(1000000).cast("long"))


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def file_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, regexp_matches(text, '[#$%&*]{3}') AND strlen(regexp_extract(text, '(?s)^(.*?)[#$%&*]{3}', 1)) < 512 AS is_binary FROM documents")
def binary_sniff(spark, sf_dir):
    """A run of three signs stands for a zero byte."""
    body = F.encode(F.regexp_replace("text", "[#$%&*]{3}", "\0"), "UTF-8")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.looks_binary(body).alias("is_binary"))


@query(f"{duck('manifest_files')} SELECT path, hash, pattern_id, scanned FROM manifest_files WHERE path = (SELECT min(path) FROM manifest_files)")
def manifest_lookup(spark, sf_dir):
    m = view(spark, sf_dir, "manifest_files")
    return changes.lookup(m, m.agg(F.min("path")).scalar())


# -- commits --------------------------------------------------------------

_COMMITS = duck("commits", "deltas", "manifest_commits")
_STATS = "stats AS (SELECT c.hash, count(d.hash) AS files_changed, CAST(coalesce(sum(insertions), 0) AS BIGINT) AS insertions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deletions FROM commits c LEFT JOIN deltas d ON c.hash = d.hash GROUP BY 1)"


def _best(column: str, table: dict[str, float]) -> tuple[str, str]:
    order = sorted(table, key=lambda t: (-table[t], t))
    rungs = lambda f: "CASE " + " ".join(f"WHEN contains({column}, '{t}') THEN {f(t)}" for t in order)
    return rungs(lambda t: round(table[t] * 100)) + " ELSE 0 END", rungs(lambda t: f"'{t}'") + " END"


_PH, _PT = _best("path", PATH_RULES)
_MH, _MT = _best("lower(message)", MESSAGE_RULES)
_SCORED = f"""per AS (SELECT hash, insertions + deletions AS l, regexp_matches(path, '\\.(md|txt|rst)$') AS doc, {_PH} AS h, {_PT} AS t FROM deltas),
agg AS (SELECT hash, CAST(sum(l) AS BIGINT) AS lines, count(*) AS n, count(*) FILTER (doc) AS docs, max(h) AS h FROM per GROUP BY 1),
tok AS (SELECT hash, min(t) AS t FROM per JOIN agg USING (hash) WHERE per.h = agg.h AND per.h > 0 GROUP BY 1),
base AS (SELECT c.hash, n_parents = 1 AS single, coalesce(lines, 0) AS lines, coalesce(n, 0) AS n, coalesce(docs, 0) AS docs, coalesce(h, 0) AS h, t, {_MH} AS mh, {_MT} AS mt
  FROM commits c LEFT JOIN agg ON c.hash = agg.hash LEFT JOIN tok ON c.hash = tok.hash),
d AS (SELECT *, CASE WHEN lines <= 10 THEN 10 WHEN lines <= 50 THEN 30 WHEN lines <= 200 THEN 50 WHEN lines <= 500 THEN 70 ELSE 100 END * CASE WHEN lines <= 1 OR (n > 0 AND 5 * docs > 4 * n) THEN 5 ELSE 10 END AS ds FROM base),
tot AS (SELECT *, (CASE WHEN single THEN ds ELSE 500 END * 3 + CASE WHEN single THEN h ELSE 50 END * 40 + mh * 30) AS tenths FROM d),
scored AS (SELECT hash, CAST(tenths / 10000.0 AS FLOAT) AS significance, CASE WHEN tenths >= 8000 THEN 'Critical' WHEN tenths >= 6000 THEN 'High' WHEN tenths >= 4000 THEN 'Medium' WHEN tenths >= 2000 THEN 'Low' ELSE 'Trivial' END AS category,
  CASE WHEN single THEN lines END AS lines, CASE WHEN single THEN ds / 1000.0 END AS diff_score, CASE WHEN single THEN t END AS pattern, CASE WHEN single AND t IS NOT NULL THEN h / 100.0 END AS pattern_score,
  mt AS keyword, CASE WHEN mt IS NOT NULL THEN mh / 100.0 END AS message_score FROM tot)"""


def _scored(spark, sf_dir) -> DataFrame:
    return commits.score_commits(view(spark, sf_dir, "commits"), view(spark, sf_dir, "deltas"), PATH_RULES, MESSAGE_RULES)


@query(f"{_COMMITS}, {_STATS} SELECT * FROM stats")
def commit_diffstats(spark, sf_dir):
    return commits.diff_stats(view(spark, sf_dir, "commits"), view(spark, sf_dir, "deltas"))


@query(f"{_COMMITS}, {_STATS.replace('ON c.hash = d.hash', 'ON c.hash = d.hash AND starts_with(path, ' + chr(39) + 'PROMO' + chr(39) + ')')} SELECT * FROM stats")
def commit_diffstats_under(spark, sf_dir):
    return commits.diff_stats(view(spark, sf_dir, "commits"), view(spark, sf_dir, "deltas"), under="PROMO")


@query(f"{_COMMITS} SELECT hash, pos FROM commits WHERE hash IN (SELECT hash FROM deltas WHERE starts_with(path, 'PROMO'))")
def commits_touching(spark, sf_dir):
    return commits.touching(view(spark, sf_dir, "commits"), view(spark, sf_dir, "deltas"), "PROMO").select("hash", "pos")


@query(f"{_COMMITS}, {_SCORED} SELECT hash, CAST(round(significance * 1000) AS BIGINT) AS thousandths, category FROM scored")
def commit_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("hash", F.round(F.col("significance").cast("double") * 1000).cast("long").alias("thousandths"), "category")


@query(f"{_COMMITS}, {_SCORED} SELECT hash, lines, CAST(diff_score AS DOUBLE) AS diff_score, pattern, CAST(pattern_score AS DOUBLE) AS pattern_score, keyword, CAST(message_score AS DOUBLE) AS message_score FROM scored")
def commit_factors(spark, sf_dir):
    return _scored(spark, sf_dir).select("hash", "lines", "diff_score", "pattern", "pattern_score", "keyword", "message_score")


@query(f"{_COMMITS}, {_SCORED} SELECT hash, category FROM scored WHERE category IN ('Critical', 'High', 'Medium')")
def significant_commits(spark, sf_dir):
    return commits.significant(_scored(spark, sf_dir)).select("hash", "category")


@query(f"""{duck('commits')} SELECT hash, CASE WHEN contains(m, 'migrat') OR contains(m, 'schema') OR contains(m, 'upgrade') THEN 'migration' WHEN contains(m, 'fix') OR contains(m, 'bug') OR contains(m, 'patch') THEN 'bug' ELSE 'decision' END AS category, s AS summary
FROM (SELECT hash, split_part(m0, chr(10), 1) AS s, lower(split_part(m0, chr(10), 1)) AS m FROM (SELECT hash, concat(CASE okey % 4 WHEN 0 THEN 'Fix ' WHEN 1 THEN 'Upgrade ' ELSE '' END, message) AS m0 FROM commits))""")
def commit_category(spark, sf_dir):
    kind = F.when(F.col("okey") % 4 == 0, "Fix ").when(F.col("okey") % 4 == 1, "Upgrade ").otherwise("")
    summary = text.summary(F.concat(kind, "message"))
    return view(spark, sf_dir, "commits").select("hash", rules.infer_commit_category(summary).alias("category"), summary.alias("summary"))


@query(f"{duck('commits')} SELECT hash, pos FROM commits WHERE n_parents <= 1")
def skip_merges(spark, sf_dir):
    return commits.skip_merges(view(spark, sf_dir, "commits")).select("hash", "pos")


@query(f"""{duck('commits')}, page AS (SELECT * FROM commits WHERE pos > 20 AND n_parents <= 1 ORDER BY pos LIMIT 50)
SELECT hash, pos, false AS is_next FROM page UNION ALL SELECT * FROM (SELECT hash, pos, true FROM commits WHERE pos > (SELECT max(pos) FROM page) ORDER BY pos LIMIT 1)""")
def walk_page(spark, sf_dir):
    return commits.walk_page(view(spark, sf_dir, "commits"), after=20, limit=50, merges=False).select("hash", "pos", "is_next")


@query(f"{duck('dated_commits', 'dated_manifest')} SELECT hash, pos FROM dated_commits WHERE pos > (SELECT coalesce(max(pos), 0) FROM dated_commits WHERE hash IN (SELECT sha FROM dated_manifest))")
def new_commits_prefix(spark, sf_dir):
    return commits.new_prefix(view(spark, sf_dir, "dated_commits"), view(spark, sf_dir, "dated_manifest")).select("hash", "pos")


@query(f"{duck('manifest_commits')} SELECT sha, processed_at FROM manifest_commits WHERE processed_at > 300")
def commits_since(spark, sf_dir):
    m = view(spark, sf_dir, "manifest_commits")
    return commits.commits_since(m, F.sha2(F.lit("300"), 256)).select("sha", "processed_at")


@query(f"{duck('commits', 'manifest_commits')} SELECT hash, pos FROM commits WHERE hash NOT IN (SELECT sha FROM manifest_commits)")
def unprocessed_commits(spark, sf_dir):
    return commits.unprocessed(view(spark, sf_dir, "commits"), view(spark, sf_dir, "manifest_commits")).select("hash", "pos")


@query(f"""{duck('commits', 'manifest_commits')} SELECT count(*) AS total, (SELECT count(*) FROM manifest_commits) AS processed, count(*) FILTER (hash NOT IN (SELECT sha FROM manifest_commits)) AS unprocessed FROM commits WHERE n_parents <= 1""")
def commit_status(spark, sf_dir):
    return commits.commit_counts(view(spark, sf_dir, "commits"), view(spark, sf_dir, "manifest_commits"))


@query(f"""{duck('commits', 'manifest_commits')}, u AS (SELECT * FROM commits WHERE n_parents <= 1 AND hash NOT IN (SELECT sha FROM manifest_commits))
SELECT left(hash, 7) AS short_hash, pos, greatest((SELECT count(*) FROM u) - 20, 0) AS more FROM u ORDER BY pos DESC LIMIT 20""")
def status_commits(spark, sf_dir):
    u = commits.unprocessed(commits.skip_merges(view(spark, sf_dir, "commits")), view(spark, sf_dir, "manifest_commits"))
    more = u.agg(F.greatest(F.count("*") - 20, F.lit(0))).scalar()
    return u.orderBy(F.desc("pos")).limit(20).select(F.left("hash", F.lit(7)).alias("short_hash"), "pos", more.alias("more"))


_RULE_TABLE = """SELECT CASE p_partkey % 3 WHEN 0 THEN concat(p_type, '/', p_name) WHEN 1 THEN concat(split_part(p_name, ' ', 2), CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE '.py' END) ELSE concat(p_brand, '-', CAST(p_partkey AS STRING)) END AS token,
(1 + p_partkey % 97) / CAST(100 AS DOUBLE) AS weight FROM part"""
_TABLE_SCORED = _SCORED.replace(f"{_PH} AS h, {_PT} AS t FROM deltas", "coalesce(h, 0) AS h, t FROM deltas LEFT JOIN hits USING (path)")


@query(f"""{_COMMITS}, rule AS (SELECT token AS t, CAST(round(max(weight) * 100) AS INTEGER) AS h FROM ({_RULE_TABLE.replace('STRING', 'VARCHAR')}) GROUP BY token),
hits AS (SELECT path, h, t FROM (SELECT DISTINCT path FROM deltas) JOIN rule ON contains(path, t) QUALIFY row_number() OVER (PARTITION BY path ORDER BY h DESC, t) = 1), {_TABLE_SCORED}
SELECT hash, CAST(round(significance * 1000) AS BIGINT) AS thousandths, category, pattern FROM scored""")
def commit_score_rules(spark, sf_dir):
    table = spark.sql(_RULE_TABLE.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    scored = commits.score_commits(view(spark, sf_dir, "commits"), view(spark, sf_dir, "deltas"), table, MESSAGE_RULES)
    return scored.select("hash", F.round(F.col("significance").cast("double") * 1000).cast("long").alias("thousandths"), "category", "pattern")


_LINES = "string_split(concat(coalesce(text, ''), chr(10)), chr(10))[1:-2]"


@query(f"""WITH x AS (SELECT concat('f', doc_id) AS path, doc_id % 10 AS k, len(l) AS n, len(list_filter(l, lambda s: length(s) % 3 = 0)) AS gone, len(list_filter(l, lambda s: length(s) % 3 <> 0 AND length(s) % 5 = 0)) AS other
  FROM (SELECT doc_id, {_LINES} AS l FROM documents)),
y AS (SELECT path, k, CASE k WHEN 8 THEN n - gone WHEN 9 THEN 0 ELSE other END AS insertions, CASE k WHEN 8 THEN 0 WHEN 9 THEN n ELSE gone + other END AS deletions FROM x)
SELECT path, CAST(insertions AS BIGINT) AS insertions, CAST(deletions AS BIGINT) AS deletions, false AS is_binary FROM y WHERE k = 8 OR insertions + deletions > 0""")
def content_diffstats(spark, sf_dir):
    """Texts, and what they are without lines of some lengths and with a mark before those of others; some files are new or gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("f"), "doc_id").alias("path"), (F.col("doc_id") % 10).alias("k"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    kept = F.filter("l", lambda s: F.char_length(s) % 3 != 0)
    other = F.transform(kept, lambda s: F.when(F.char_length(s) % 5 == 0, F.concat(F.lit("\u0001"), s)).otherwise(s))
    whole = lambda lines: F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "").alias("content")
    return line_diff.content_diffs(docs.where("k <> 8").select("path", whole(F.col("l"))), docs.where("k <> 9").select("path", whole(other)))


_HISTORY = f"{duck('history', 'dated_manifest').replace('WITH ', 'WITH RECURSIVE ', 1)}, edges AS (SELECT hash, parent1 AS parent FROM history WHERE parent1 IS NOT NULL UNION SELECT hash, parent2 FROM history WHERE parent2 IS NOT NULL)"


def _history(spark, sf_dir) -> DataFrame:
    h = view(spark, sf_dir, "history")
    return h.select("hash", "timestamp", F.filter(F.array("parent1", "parent2"), lambda x: x.isNotNull()).alias("parent_hashes"))


@query(f"""{_HISTORY}, reached AS (SELECT sha AS hash FROM dated_manifest UNION SELECT parent FROM reached JOIN edges USING (hash))
SELECT hash, timestamp FROM history WHERE hash NOT IN (SELECT hash FROM reached)""")
def commits_not_reached(spark, sf_dir):
    return history.not_reached(_history(spark, sf_dir), view(spark, sf_dir, "dated_manifest").withColumnRenamed("sha", "hash")).select("hash", "timestamp")


@query(f"""{_HISTORY}, paths AS (SELECT hash, CAST(1 AS BIGINT) AS layer FROM history WHERE hash NOT IN (SELECT hash FROM edges) UNION SELECT edges.hash, layer + 1 FROM paths JOIN edges ON parent = paths.hash),
layers AS (SELECT hash, max(layer) AS layer FROM paths GROUP BY hash)
SELECT hash, layer, row_number() OVER (ORDER BY layer, timestamp, hash) AS pos FROM layers JOIN history USING (hash)""")
def topological_pos(spark, sf_dir):
    return history.topological_pos(_history(spark, sf_dir))


_RULES = [("", "de/\n*7.txt\n!/fr/**/*17.txt\n"), ("es", "src[0-4]/\n# all\n")]


@query(f"""{duck('files_now')} SELECT path FROM files_now WHERE starts_with(path, 'de/') OR regexp_matches(path, '^es/src[0-4]/') OR (ends_with(path, '7.txt') AND NOT (starts_with(path, 'fr/') AND ends_with(path, '17.txt')))""")
def ignored_files(spark, sf_dir):
    return ignored.ignored_files(view(spark, sf_dir, "files_now"), spark.createDataFrame(_RULES, "folder string, content string")).select("path")


# -- synthesis ------------------------------------------------------------

_TAGGED = f"{duck('tagged')}, c AS (SELECT *, {_inferred('what', 'why', 'how')} AS category FROM tagged)"
_EQUAL = f"{_TAGGED}, k AS (SELECT *, min(seq) OVER (PARTITION BY category, lower(what)) AS cluster_id FROM c)"


def _tagged(spark, sf_dir) -> DataFrame:
    t = entries.with_category(view(spark, sf_dir, "tagged"))
    return t.withColumns({"files": F.array("file"), "outcome": F.create_map(F.lit("size"), F.col("outcome_size"))})


def _equal(spark, sf_dir) -> DataFrame:
    return synthesis.cluster_equal(_tagged(spark, sf_dir))


_CLUSTERED = f"""{_TAGGED.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS (SELECT category, lower(what) AS t, min(seq) AS s FROM c GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s) AS n FROM d),
r AS (SELECT category, n, t, s AS cluster_id, [struct_pack(t := t, s := s)] AS leaders FROM o WHERE n = 1 UNION ALL
  SELECT category, n, t, coalesce(hit, s), CASE WHEN hit IS NULL THEN list_append(leaders, struct_pack(t := t, s := s)) ELSE leaders END FROM (
    SELECT o.category, o.n, o.t, o.s, r.leaders, list_filter(r.leaders, lambda x: levenshtein(x.t, o.t) < 3)[1].s AS hit FROM r JOIN o ON o.category = r.category AND o.n = r.n + 1)),
k AS (SELECT c.*, r.cluster_id FROM c JOIN r ON c.category = r.category AND lower(c.what) = r.t)"""


@query(f"{_CLUSTERED} SELECT seq, cluster_id FROM k")
def cluster_leaders(spark, sf_dir):
    return synthesis.cluster(_tagged(spark, sf_dir)).select("seq", "cluster_id")


_WHAT = """m_counts AS (SELECT cluster_id, trim(what) AS what, count(*) AS n, min(seq) AS f FROM k GROUP BY 1, 2), m_order AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n >= 2 DESC, strlen(what), f) AS i, count(*) OVER (PARTITION BY cluster_id) AS n_values FROM m_counts),
m_what AS (SELECT cluster_id, what, n_values FROM m_order WHERE i = 1)"""


@query(f"{_EQUAL}, {_WHAT} SELECT * FROM m_what")
def merge_what(spark, sf_dir):
    return synthesis.merge_what(_equal(spark, sf_dir))


def _merged(column: str, sep: str, glue: str) -> str:
    split = f"string_split({column}, {sep})"
    return f"""p_{column} AS (SELECT cluster_id, seq, generate_subscripts({split}, 1) AS i, trim(unnest({split})) AS part FROM k),
once_{column} AS (SELECT cluster_id, part, min(seq * 1000 + i) AS place FROM p_{column} WHERE part <> '' GROUP BY 1, 2), m_{column} AS (SELECT cluster_id, string_agg(part, {glue} ORDER BY place) AS {column} FROM once_{column} GROUP BY 1)"""


_WHY, _HOW = _merged("why", "'.'", "'. '"), _merged("how", "chr(10)", "chr(10)")


@query(f"{_EQUAL}, {_WHY} SELECT * FROM m_why")
def merge_why(spark, sf_dir):
    return synthesis.merge_why(_equal(spark, sf_dir))


@query(f"{_EQUAL}, {_HOW} SELECT * FROM m_how")
def merge_how(spark, sf_dir):
    return synthesis.merge_how(_equal(spark, sf_dir))


@query(f"{_EQUAL} SELECT cluster_id, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM k GROUP BY 1")
def merge_context(spark, sf_dir):
    return synthesis.merge_list(_equal(spark, sf_dir), "files").withColumn("files", F.array_join("files", ","))


@query(f"{_EQUAL} SELECT cluster_id, 'size' AS key, min_by(outcome_size, seq) AS value, count(DISTINCT outcome_size) AS n_values FROM k GROUP BY 1")
def merge_outcome(spark, sf_dir):
    return synthesis.merge_outcome(_equal(spark, sf_dir))


_SAID = f"""{_EQUAL}, said AS (SELECT cluster_id, 'what' AS field, seq, model, trim(what) AS value FROM k UNION ALL SELECT cluster_id, 'context.outcome.size', seq, model, outcome_size FROM k),
odd AS (SELECT * FROM said WHERE (cluster_id, field) IN (SELECT (cluster_id, field) FROM said GROUP BY cluster_id, field HAVING count(DISTINCT value) > 1))"""
_VOTED = f"""{_SAID}, w AS (SELECT *, CASE lower(model) WHEN 'claude' THEN 12 WHEN 'gemini' THEN 11 ELSE 10 END AS t, lower(trim(value)) AS norm FROM odd),
g AS (SELECT cluster_id, field, norm, sum(t) AS t, min_by(value, seq) AS value, min(seq) AS f FROM w GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY t DESC, f) AS i, count(*) OVER (PARTITION BY cluster_id, field) AS n FROM g),
heavy AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY t DESC, seq) AS i FROM w),
voted AS (SELECT a.cluster_id, a.field, CASE WHEN a.t >= 20 THEN 'majority' WHEN a.n > 1 THEN 'highest_weight' ELSE 'merged' END AS kind, CASE WHEN a.t >= 20 THEN a.value WHEN a.n > 1 THEN h.value END AS winner,
  CASE WHEN a.t < 20 AND a.n > 1 THEN h.model END AS model, CAST(CASE WHEN a.t >= 20 THEN a.t WHEN a.n > 1 THEN h.t END AS BIGINT) AS tenths
  FROM top a JOIN heavy h ON a.cluster_id = h.cluster_id AND a.field = h.field WHERE a.i = 1 AND h.i = 1)"""


@query(f"{_SAID} SELECT cluster_id, field, seq, model, value FROM odd")
def conflicts(spark, sf_dir):
    return synthesis.conflicts(_equal(spark, sf_dir))


@query(f"{_VOTED} SELECT * FROM voted")
def vote(spark, sf_dir):
    return synthesis.vote(synthesis.conflicts(_equal(spark, sf_dir)))


@query(f"""{_VOTED}, e AS (SELECT count(*) AS n_inputs, count(DISTINCT cluster_id) AS n_outputs, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM k), v AS (SELECT count(*) AS n_conflicts, count(*) AS n_resolved, CAST(0 AS BIGINT) AS n_manual FROM voted)
SELECT *, CAST(least(100.0, n_outputs * 100.0 / n_inputs) AS DOUBLE) AS output_ratio_pct FROM e, v""")
def synthesis_report(spark, sf_dir):
    return synthesis.report(_equal(spark, sf_dir))


def _synthesized(base: str) -> str:
    """Of clusters k: votes, merging and what a cluster of one is, brought together."""
    return f"""{_VOTED.replace(_EQUAL, base)}, {_WHAT}, {_WHY}, {_HOW},
single AS (SELECT cluster_id, count(*) AS n_entries, any_value(what) AS w, any_value(why) AS y, any_value(how) AS h, string_agg(DISTINCT file, ',' ORDER BY file) AS files, min_by(outcome_size, seq) AS first_size FROM k GROUP BY 1),
brought AS (SELECT s.cluster_id, n_entries, trim(CASE WHEN n_entries = 1 THEN w ELSE coalesce(v.winner, what) END) AS what, trim(CASE WHEN n_entries = 1 THEN y ELSE coalesce(why, '') END) AS why, trim(CASE WHEN n_entries = 1 THEN h ELSE coalesce(how, '') END) AS how, files, coalesce(o.winner, first_size) AS outcome_size
  FROM single s JOIN m_what USING (cluster_id) LEFT JOIN m_why USING (cluster_id) LEFT JOIN m_how USING (cluster_id) LEFT JOIN voted v ON v.cluster_id = s.cluster_id AND v.field = 'what' LEFT JOIN voted o ON o.cluster_id = s.cluster_id AND o.field = 'context.outcome.size')
SELECT *, {_inferred('what', 'why', 'how')} AS category FROM brought"""


def _flat(merged: DataFrame) -> DataFrame:
    return merged.withColumn("files", F.array_join("files", ",")).withColumn("outcome_size", F.col("outcome")["size"]).drop("outcome")


@query(_synthesized(_CLUSTERED))
def synthesize(spark, sf_dir):
    return _flat(synthesis.synthesize(synthesis.cluster(_tagged(spark, sf_dir))))


@query(_synthesized(_EQUAL))
def synthesize_equal(spark, sf_dir):
    return _flat(synthesis.synthesize(_equal(spark, sf_dir)))


@query(f"{_TAGGED} SELECT category, count(*) AS n, min(seq) AS first_seq FROM c GROUP BY 1")
def group_by_category(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


# -- prompts and replies --------------------------------------------------


@query(f"""{duck('files_now')}, t AS (SELECT path, size, string_split(text, chr(10)) AS l FROM files_now ORDER BY path LIMIT 50),
s AS (SELECT path, concat('## ', path, ', ', size, ' bytes', chr(10), array_to_string(l[1:200], chr(10)), CASE WHEN len(l) > 200 THEN concat(chr(10), '[', len(l) - 200, ' further lines left out]', chr(10)) ELSE '' END, chr(10), chr(10)) AS s
  FROM (SELECT path, size, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM t))
SELECT concat(string_agg(s, '' ORDER BY path), CASE WHEN (SELECT count(*) FROM files_now) > 50 THEN concat('[', (SELECT count(*) FROM files_now) - 50, ' further files left out]', chr(10)) ELSE '' END) AS prompt FROM s""")
def prompt_files(spark, sf_dir):
    return prompts.prompt_files(view(spark, sf_dir, "files_now"), head="")


@query(f"""{duck('commits', 'deltas', 'authors')}, {_STATS} SELECT hash, concat(left(hash, 7), ' by ', coalesce(name, 'Unknown'), ' <', coalesce(email, 'unknown@example.com'), '>: ', split_part(message, chr(10), 1), chr(10), '  files ', files_changed, ', lines +', insertions, ' -', deletions, chr(10), chr(10)) AS section
FROM commits JOIN stats USING (hash) JOIN authors USING (hash)""")
def prompt_commits(spark, sf_dir):
    c = view(spark, sf_dir, "commits")
    rows = c.join(commits.diff_stats(c, view(spark, sf_dir, "deltas")), "hash").join(view(spark, sf_dir, "authors"), "hash")
    who = text.author(F.col("name"), F.col("email"))
    return rows.select("hash", prompts.commit_section(F.left("hash", F.lit(7)), who, text.summary(F.col("message")), F.col("files_changed"), F.col("insertions"), F.col("deletions")).alias("section"))


@query(f"{duck('replies')} SELECT model, count(*) FILTER (error IS NULL) AS successes, count(*) FILTER (error IS NOT NULL) AS failures FROM replies GROUP BY 1")
def model_fanout(spark, sf_dir):
    return prompts.model_counts(view(spark, sf_dir, "replies"))


@query(f"""{duck('replies')}, k AS (SELECT *, CASE WHEN contains(lower(error), '429') OR contains(lower(error), 'rate limit') OR contains(lower(error), 'quota exceeded') THEN 'rate_limit' WHEN contains(lower(error), 'unauthorized') OR contains(lower(error), 'authentication') OR contains(lower(error), '401') THEN 'auth'
WHEN contains(lower(error), '503') OR contains(lower(error), 'unavailable') THEN 'unavailable' ELSE 'request_failed' END AS kind FROM replies WHERE error IS NOT NULL)
SELECT seq, model, kind, kind IN ('rate_limit', 'unavailable', 'timeout') AS retryable, kind = 'auth' AS fatal, TRY_CAST(regexp_extract(error, '(?i)retry[- ]after:?\\s*(\\d+)', 1) AS BIGINT) AS retry_after, left(error, 200) AS snippet FROM k""")
def error_classify(spark, sf_dir):
    return prompts.classify_failures(view(spark, sf_dir, "replies"))


@query(f"""{duck('replies')} SELECT seq, CASE WHEN contains(error, '429') THEN concat(model, ' takes no more requests for now: ', error) WHEN error = 'Unauthorized' THEN concat(model, ' does not accept the credentials: ', error)
WHEN error = 'service Unavailable' THEN concat(model, ' cannot be reached: ', error) ELSE concat(model, ' failed: ', error) END AS message FROM replies WHERE error IS NOT NULL""")
def failure_messages(spark, sf_dir):
    failed = view(spark, sf_dir, "replies").where("error IS NOT NULL")
    return failed.select("seq", replies.failure_message(replies.error_class(F.col("error")), F.col("model"), F.col("error")).alias("message"))


@query(f"{duck('replies')} SELECT seq, response AS message FROM replies")
def reply_payload(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("response").alias("agent_message"), "model"))
    return view(spark, sf_dir, "replies").select("seq", replies.agent_message(payload).alias("message"))


_RENDERED = """SELECT seq, model, CASE seq % 5
  WHEN 0 THEN concat('what = "', what, '"', chr(10), 'why = "', why, '"', chr(10), 'how = "h"')
  WHEN 1 THEN concat('[[entry]]', chr(10), 'what = "', what, '"', chr(10), 'why = "y"', chr(10), 'how = "h"', chr(10), '[[entry]]', chr(10), 'what = "two"', chr(10), 'why = "y"', chr(10), 'how = "h"')
  WHEN 2 THEN concat('what = "', what, '"', chr(10), 'why = "y"', chr(10), 'how = "h"', chr(10), '---', chr(10), 'broken', chr(10), '---', chr(10), 'what = "b"', chr(10), 'why = "y"', chr(10), 'how = "h"')
  WHEN 3 THEN '' ELSE what END AS response FROM tagged"""


@query(f"""{duck('tagged')} SELECT seq, model, 0 AS entry_no, what, CAST(NULL AS VARCHAR) AS error FROM tagged WHERE seq % 5 < 3
UNION ALL SELECT seq, model, 1, CASE seq % 5 WHEN 1 THEN 'two' ELSE 'b' END, NULL FROM tagged WHERE seq % 5 IN (1, 2) UNION ALL SELECT seq, model, NULL, NULL, 'no entry in the reply' FROM tagged WHERE seq % 5 > 2""")
def parse_response(spark, sf_dir):
    raw = spark.sql(_RENDERED.replace("FROM tagged", "FROM {tagged}"), tagged=view(spark, sf_dir, "tagged"))
    return prompts.parse_responses(raw).select("seq", "model", "entry_no", "what", "error")


@query(f"""{duck('files_now')}, p AS (SELECT CASE WHEN starts_with(path, 'en/') THEN concat('/work/', path) ELSE path END AS path FROM files_now)
SELECT path, CASE WHEN starts_with(path, '/work/') THEN substr(path, 7) ELSE path END AS relative FROM p""")
def relative_paths(spark, sf_dir):
    p = view(spark, sf_dir, "files_now").select(F.when(F.startswith("path", F.lit("en/")), F.concat(F.lit("/work/"), "path")).otherwise(F.col("path")).alias("path"))
    return p.select("path", text.relative(F.col("path"), "/work").alias("relative"))


@query(f"""{duck('commits', 'deltas', 'authors')}, {_STATS}, n AS (SELECT row_number() OVER (ORDER BY pos, hash) AS n, c.hash, message, name, email, files_changed, insertions, deletions FROM commits c JOIN stats USING (hash) JOIN authors USING (hash))
SELECT (n - 1) // 1000 AS page, string_agg(concat(left(hash, 7), ' by ', coalesce(name, 'Unknown'), ' <', coalesce(email, 'unknown@example.com'), '>: ', split_part(message, chr(10), 1), chr(10), '  files ', files_changed, ', lines +', insertions, ' -', deletions, chr(10), chr(10)), '' ORDER BY n) AS prompt
FROM n GROUP BY 1""")
def commit_prompts(spark, sf_dir):
    c, d, a = (view(spark, sf_dir, x) for x in ("commits", "deltas", "authors"))
    rows = c.select("hash", "pos", "message").join(commits.diff_stats(c, d), "hash").join(a.select("hash", text.author(F.col("name"), F.col("email")).alias("author")), "hash")
    return prompts.prompt_commits(rows, head="")


#: Tasks that calls of local providers are dealt to.
_TASKS = 64
_ANSWERS = {"long": lambda p: f"{len(p)} {p[:5]}", "strict": lambda p: p[-3:] if len(p) % 2 == 0 else _refuse()}


def _refuse() -> str:
    raise ValueError("Unauthorized")


@query("""WITH p AS (SELECT doc_id, left(coalesce(text, ''), 50) AS p FROM documents)
SELECT doc_id * 2 AS seq, 'long' AS model, concat(length(p), ' ', left(p, 5)) AS response, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT doc_id * 2 + 1, 'strict', CASE WHEN length(p) % 2 = 0 THEN right(p, 3) END, CASE WHEN length(p) % 2 = 1 THEN 'Unauthorized' END FROM p""")
def provider_answers(spark, sf_dir):
    """Every text's start asked of two local providers, one of which refuses some."""
    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("text").alias("prompt_type"), F.left(F.coalesce("text", F.lit("")), F.lit(50)).alias("prompt"), F.col("doc_id").alias("no"))
    return prompts.fan_out(asked, _ANSWERS, tasks=_TASKS).select("seq", "model", "response", "error")


@query(f"""{duck('files_now', 'manifest_files')}, t AS (SELECT path, size, string_split(text, chr(10)) AS l FROM files_now ORDER BY path LIMIT 50),
s AS (SELECT path, concat('## ', path, ', ', size, ' bytes', chr(10), array_to_string(l[1:200], chr(10)), CASE WHEN len(l) > 200 THEN concat(chr(10), '[', len(l) - 200, ' further lines left out]', chr(10)) ELSE '' END, chr(10), chr(10)) AS s
  FROM (SELECT path, size, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM t))
SELECT concat((SELECT string_agg(concat('- ', pattern_id, chr(10)), '' ORDER BY pattern_id) FROM (SELECT DISTINCT pattern_id FROM manifest_files)), string_agg(s, '' ORDER BY path)) AS prompt FROM s""")
def prompt_patterns(spark, sf_dir):
    ids = view(spark, sf_dir, "manifest_files").select("pattern_id").distinct()
    return prompts.prompt_patterns(ids, view(spark, sf_dir, "files_now"), head="")
