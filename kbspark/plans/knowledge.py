"""A knowledge base: create it, learn from a code base, ask, and tell its state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import rules, text
from kbspark.operators import changes, commits, entries, prompts, search, synthesis
from kbspark.shared import stored
from kbspark.sources.store import read_table, upsert_buckets, write_table

ENTRIES = "category string, slug string, what string, why string, how string, files array<string>, commits array<string>, dependencies array<string>, outcome map<string,string>, body string"
PATTERNS = "pattern_id string, name string, created timestamp, last_updated timestamp"
LINKS = "pattern_id string, path string"
FILES = "path string, hash string, size long, pattern_id string"
COMMITS = "sha string, category string, processed_at timestamp"


class AlreadyThere(Exception):
    pass


class AllProvidersFailed(Exception):
    pass


def ignore_line(content: str | None, kb_dir: str = ".kb") -> str:
    """The text of a ``.gitignore`` that leaves out the knowledge folder.

    >>> ignore_line("a")
    'a\\n.kb/\\n'
    """
    have = content or ""
    if any(x.strip() == f"{kb_dir}/" for x in have.split("\n")):
        return have
    return have + ("\n" if have and not have.endswith("\n") else "") + f"{kb_dir}/\n"


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def init(self) -> None:
        """Empty tables, one for each kind of row; AlreadyThere if there are some."""
        if read_table(self.spark, self.root, "meta", "n int").count():
            raise AlreadyThere(self.root)
        for name, schema in {"entries": ENTRIES, "files": FILES, "commits": COMMITS, "patterns": PATTERNS, "links": LINKS}.items():
            write_table(self.spark.createDataFrame([], schema), self.root, name)
        write_table(self.spark.range(1).select(F.lit(1).alias("n")), self.root, "meta")

    def table(self, name: str, schema: str) -> DataFrame:
        return read_table(self.spark, self.root, name, schema)

    def entries(self) -> DataFrame:
        return self.table("entries", ENTRIES).withColumn("file_name", F.concat("slug", F.lit(".toml")))

    def ask(self, query: str, max_results: int = 10, category: str | None = None) -> DataFrame:
        return search.ask(self.entries(), query, max_results, category)

    def status(self, files: DataFrame, history: DataFrame) -> DataFrame:
        """One row of structs: files (with how many of the changed ones are new or
        modified), commits, knowledge and whether all is up to date."""
        manifest = self.table("files", FILES)
        kinds = changes.scan_changes(files, manifest).agg(F.struct(F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "modified").alias("modified")))
        scan = changes.scan_counts(files, manifest).withColumn("kinds", kinds.scalar()).select(F.struct("total", "changed", "deleted", "unchanged", "kinds.new", "kinds.modified").alias("files"))
        walk = commits.commit_counts(history, self.table("commits", COMMITS)).select(F.struct("*"))
        known = search.status_counts(self.entries()).select(F.struct("*"))
        row = scan.withColumns({"commits": walk.scalar(), "knowledge": known.scalar()})
        return row.withColumn("up_to_date", (F.col("files.changed") == 0) & (F.col("files.deleted") == 0) & (F.col("commits.unprocessed") == 0))

    def pending(self, files: DataFrame, history: DataFrame, deltas: DataFrame, full: bool = False) -> dict[str, DataFrame]:
        """What a run would look at: changed files, deleted paths, significant new commits, invalidated patterns."""
        manifest = self.table("files", FILES)
        fresh = commits.unprocessed(commits.skip_merges(history), self.table("commits", COMMITS), full)
        return {
            "changed": changes.scan_changes(files, manifest, full).where("is_changed OR is_new"), "deleted": changes.deleted(files, manifest),
            "commits": fresh.join(commits.significant(commits.score_commits(fresh, deltas)).select("hash"), "hash", "left_semi"), "patterns": changes.invalidated_patterns(files, manifest),
        }

    def questions(self, todo: dict[str, DataFrame], files: DataFrame, deltas: DataFrame) -> DataFrame | None:
        """Up to three prompts (prompt_type, prompt): of changed files, of commits, and
        of invalidated patterns with their files; None if none of them has rows."""
        changed = files.join(todo["changed"].select("path"), "path", "left_semi")
        author = F.col("author") if "author" in todo["commits"].columns else F.lit(None).cast("string")
        new = todo["commits"].select("hash", "pos", "message", author.alias("author")).join(commits.diff_stats(todo["commits"], deltas), "hash")
        rest_on = changes.pattern_files(todo["patterns"], self.table("files", FILES), files).select("path")
        texts = files.join(rest_on, "path", "left_semi")
        found = {"files": (todo["changed"], prompts.prompt_files(changed)), "commits": (todo["commits"], prompts.prompt_commits(new)), "patterns": (rest_on, prompts.prompt_patterns(todo["patterns"], texts))}
        asked = None
        for kind, (rows, prompt) in found.items():
            if rows.limit(1).count():
                page = F.col("page") if "page" in prompt.columns else F.lit(0)
                one = prompt.select(F.lit(kind).alias("prompt_type"), "prompt", (list(found).index(kind) * F.lit(1 << 32) + page).alias("no"))
                asked = one if asked is None else asked.unionByName(one)
        return asked

    def drift(self, files: DataFrame, history: DataFrame, deltas: DataFrame, full: bool = False) -> DataFrame:
        """What a run would work on, without a run: kind (new, modified, deleted, commit, pattern), name
        (a path, a short hash or an id) and what (a commit's summary); no rows if all is up to date."""
        todo = self.pending(files, history, deltas, full)
        none = F.lit(None).cast("string").alias("what")
        changed = todo["changed"].select(F.when(F.col("is_new"), "new").otherwise("modified").alias("kind"), F.col("path").alias("name"), none)
        gone = todo["deleted"].select(F.lit("deleted").alias("kind"), F.col("path").alias("name"), none)
        new = todo["commits"].select(F.lit("commit").alias("kind"), F.left("hash", F.lit(7)).alias("name"), text.summary(F.col("message")).alias("what"))
        rest_on = todo["patterns"].select(F.lit("pattern").alias("kind"), F.col("pattern_id").alias("name"), none)
        return changed.unionByName(gone).unionByName(new).unionByName(rest_on)

    def link(self, patterns: DataFrame, links: DataFrame) -> None:
        """Record ``patterns`` (pattern_id, name), a known one with its first date, and which files
        they rest on: ``links`` (pattern_id, path) of known patterns and files, each once."""
        now = F.current_timestamp()
        old = self.table("patterns", PATTERNS)
        born = old.select("pattern_id", F.col("created").alias("born"))
        new = patterns.select("pattern_id", "name").dropDuplicates(["pattern_id"]).join(born, "pattern_id", "left")
        new = new.select("pattern_id", "name", F.coalesce("born", now).alias("created"), now.alias("last_updated"))
        write_table(changes.latest(old, new, "pattern_id", "last_updated"), self.root, "patterns")
        have, files = self.table("links", LINKS), self.table("files", FILES)
        write_table(changes.link_patterns(have, links, self.table("patterns", PATTERNS), files), self.root, "links")
        sides = files.select("path", "hash", "size").distinct().join(self.table("links", LINKS), "path", "left")
        known = files.where("pattern_id is not null").select("path", "hash", "size", "pattern_id")
        both = sides.select("path", "hash", "size", "pattern_id").where("pattern_id is not null").unionByName(known).distinct()
        bare = files.select("path", "hash", "size", F.lit(None).cast("string").alias("pattern_id")).distinct().join(both.select("path"), "path", "left_anti")
        write_table(both.unionByName(bare), self.root, "files")

    def learn(self, files: DataFrame, history: DataFrame, deltas: DataFrame, providers: dict[str, Callable[[str], str]], full: bool = False, need_success: bool = False) -> DataFrame:
        """One run: ask the models about what is new, bring their findings together,
        store them, and move the manifest on; returns how many entries were
        written, updated or skipped. Replies are stored before they are used, so
        that no model is asked twice."""
        files = stored(files, "files")  # what is asked about, and what the manifest gets, is one and the same scan
        todo = {k: stored(df, k) for k, df in self.pending(files, history, deltas, full).items()}
        none = self.spark.createDataFrame([], "action string, count long")
        if not any(df.limit(1).count() for df in todo.values()):
            return none
        asked = self.questions(todo, files, deltas)
        if asked is None:  # files are gone that no pattern rests on
            asked = self.spark.createDataFrame([], "prompt_type string, prompt string, no long")
            need_success = False
        answers = stored(prompts.fan_out(asked, providers), "answers")
        if need_success and not answers.where("error is null").limit(1).count():
            raise AllProvidersFailed(", ".join(providers))
        parsed = stored(prompts.parse_responses(answers.where("error is null"), strip_fences=True).where("error is null"), "parsed")
        order = entries.with_category(parsed.withColumn("seq", F.col("seq") * 1_000_000 + F.col("entry_no")))
        # one reply alone has nothing to be brought together with
        merged = synthesis.synthesize(synthesis.cluster(order)) if parsed.select("seq").distinct().limit(2).count() > 1 else order.orderBy("seq")
        batch = stored(entries.keyed(merged.withColumn("seq", F.monotonically_increasing_id())).select("seq", "category", "slug", "what", "why", "how", *entries.CONTEXT).where(~text.is_blank(F.col("what"))), "batch")
        old = self.table("entries", ENTRIES)
        seen = Observation()
        kinds = ("written", "updated", "skipped")
        actions = stored(entries.write_actions(batch, old).observe(seen, *(F.count_if(F.col("action") == k).alias(k) for k in kinds)), "actions")
        new = entries.last_of_each_key(actions).select("category", "slug", "what", "why", "how", *entries.CONTEXT, "body")
        upsert_buckets(new, self.root, "entries", ("category", "slug"), ENTRIES)
        links = self.table("files", FILES).where("pattern_id is not null")
        same = files.join(todo["changed"], "path", "left_anti").select("path")
        kept = changes.link_patterns(links.limit(0), links, links.select("pattern_id").distinct(), same)
        write_table(files.select("path", "hash", "size").join(kept, "path", "left").select("path", "hash", "size", "pattern_id"), self.root, "files")
        done = todo["commits"].select(F.col("hash").alias("sha"), rules.infer_commit_category(text.summary(F.col("message"))).alias("category"), F.current_timestamp().alias("processed_at"))
        write_table(self.table("commits", COMMITS).join(done, "sha", "left_anti").unionByName(done), self.root, "commits")
        patterns, paths = self.table("patterns", PATTERNS), self.table("links", LINKS)
        write_table(changes.touched(patterns, todo["patterns"], F.current_timestamp()), self.root, "patterns")
        write_table(paths.join(same, "path", "left_semi"), self.root, "links")  # a changed file's have to be found anew
        counts = [(k, n) for k, n in seen.get.items() if n]  # counted while the actions were written
        return self.spark.createDataFrame(counts, none.schema)

