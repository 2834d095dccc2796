"""Prompts for models, and what comes back from them."""

from __future__ import annotations

import queue
import re
import threading
import time
import tomllib
from collections.abc import Callable, Collection, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import replies, text
from kbspark.operators.history import numbered

# How much of a code base fits a prompt.
FILES_PER_PROMPT, LINES_PER_FILE = 50, 200
#: Commits beyond so many go to further prompts.
COMMITS_PER_PROMPT = 1000

ANSWER_FORMAT = "Answer with [[entry]] tables in TOML, each with what, why, how and, under [entry.context], files, commits and dependencies.\n\n"


def file_section(path: Column, size: Column, body: Column) -> Column:
    """A file's part of a prompt: a title, its first lines, and how many are left out."""
    all_lines = text.lines(body)
    n = F.size(all_lines)
    more = F.when(n > LINES_PER_FILE, F.format_string("\n[%d further lines left out]\n", n - LINES_PER_FILE)).otherwise("")
    shown = F.concat(F.array_join(F.slice(all_lines, 1, LINES_PER_FILE), "\n"), more)
    return F.concat(F.format_string("## %s, %d bytes\n", path, size), F.coalesce(shown, F.lit("[no text]\n")), F.lit("\n\n"))


def _one_text(parts: DataFrame, head: str) -> DataFrame:
    """The sections (place, section) after ``head``, as one row: prompt."""
    rows = parts.agg(F.array_sort(F.collect_list(F.struct("place", "section"))).alias("all"))
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["section"]), "")).alias("prompt"))


def prompt_files(files: DataFrame, head: str = "Describe the patterns, conventions and decisions in these files.\n" + ANSWER_FORMAT, tell_rest: bool = True) -> DataFrame:
    """One prompt of the first files by path (path, size, text), and how many are not shown."""
    shown = files.orderBy("path").limit(FILES_PER_PROMPT).select(F.struct(F.lit(0).alias("k"), F.col("path").alias("p")).alias("place"), file_section(F.col("path"), F.col("size"), F.col("text")).alias("section"))
    rest = files.agg((F.count("*") - FILES_PER_PROMPT).alias("n")).where("n > 0").select(F.struct(F.lit(1).alias("k"), F.lit("").alias("p")).alias("place"), F.format_string("[%d further files left out]\n", "n").alias("section"))
    return _one_text(shown.unionByName(rest) if tell_rest else shown, head)


def commit_section(short_hash: Column, author: Column, summary: Column, files: Column, insertions: Column, deletions: Column) -> Column:
    return F.format_string("%s by %s: %s\n  files %d, lines +%d -%d\n\n", short_hash, author, summary, files, insertions, deletions)


def prompt_commits(commits: DataFrame, head: str = "Describe the decisions, migrations and notable fixes in these commits.\n" + ANSWER_FORMAT, per_prompt: int = COMMITS_PER_PROMPT) -> DataFrame:
    """page (from 0) and prompt: ``commits`` (pos, hash, author, message, files_changed, insertions,
    deletions) in order, ``per_prompt`` of them in each; no rows without commits."""
    section = commit_section(F.left("hash", F.lit(7)), F.coalesce("author", F.lit("unknown")), text.summary(F.col("message")), F.col("files_changed"), F.col("insertions"), F.col("deletions"))
    placed = numbered(commits.select("pos", "hash", section.alias("section")), ["pos", "hash"], "n")
    pages = placed.groupBy(F.expr(f"(n - 1) div {per_prompt}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "section"))).alias("all"))
    return pages.select("page", F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["section"]), "")).alias("prompt"))


def prompt_patterns(ids: DataFrame, files: DataFrame, head: str = "Tell which of these patterns still hold.\n" + ANSWER_FORMAT) -> DataFrame:
    """One prompt of pattern ids and the files that they rest on."""
    listed = ids.select(F.struct(F.lit(0).alias("k"), F.col("pattern_id").alias("p")).alias("place"), F.format_string("- %s\n", "pattern_id").alias("section"))
    shown = files.orderBy("path").limit(FILES_PER_PROMPT).select(F.struct(F.lit(1).alias("k"), F.col("path").alias("p")).alias("place"), file_section(F.col("path"), F.col("size"), F.col("text")).alias("section"))
    return _one_text(listed.unionByName(shown), head)


def model_counts(answers: DataFrame) -> DataFrame:
    """model, successes, failures."""
    return answers.groupBy("model").agg(F.count_if(F.col("error").isNull()).alias("successes"), F.count_if(F.col("error").isNotNull()).alias("failures"))


def classify_failures(answers: DataFrame) -> DataFrame:
    """The failures with kind, retryable, fatal, retry_after and a snippet of the message."""
    kind = replies.error_class(F.col("error"))
    return answers.where("error is not null").select("seq", "model", kind.alias("kind"), replies.is_retryable(kind).alias("retryable"), replies.is_fatal(kind).alias("fatal"), replies.retry_after(F.col("error")).alias("retry_after"), replies.snippet(F.col("error")).alias("snippet"))


#: Seconds after which a provider's call counts as failed.
TIMEOUT_S = 120.0


class Waits:
    """Until when calls of a model have to wait, shared by all calls of a task."""

    def __init__(self, longest_s: float):
        self.longest_s, self.until, self.lock = longest_s, {}, threading.Lock()

    def hold(self, model: str, seconds: float) -> None:
        with self.lock:
            self.until[model] = max(self.until.get(model, 0.0), time.monotonic() + min(seconds, self.longest_s))

    def wait(self, model: str) -> None:
        while (left := self.until.get(model, 0.0) - time.monotonic()) > 0:
            time.sleep(left)


def fan_out(prompts: DataFrame, providers: dict[str, Callable[[str], str]], attempts: int = 3, wait_s: float = 1.0, timeout_s: float = TIMEOUT_S, at_once: int = 4, longest_wait_s: float = 300.0, payloads: Collection[str] = (), tasks: int | None = None) -> DataFrame:
    """Ask every provider each of ``prompts`` (prompt_type, prompt, and no, their numbers, if they
    have an order): model, prompt_type, response, error, one of the last two null, and seq, by which
    answers are in the order of the prompts and, for each, of the providers.

    A failure that a retry can help, one of no answer within ``timeout_s`` among
    them, is tried again after a doubling wait. One that says how long to wait
    holds all calls of its model in the task, ``longest_wait_s`` at most. Up to
    ``at_once`` calls of a model are under way in its task at a time. Models in
    ``payloads`` answer in JSON, of which the message is the response. Calls are
    made where the rows are; store the result before using it twice. Calls of a model
    are in one task, unless ``tasks`` are given, to which all calls are dealt evenly:
    ``at_once`` and waits hold for each of them then, so it is for providers
    without a limit that tasks would share.
    """
    if not providers:
        raise ValueError("No providers")
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(i).alias("place")) for i, m in enumerate(providers)))).alias("m")
    numbered = prompts if "no" in prompts.columns else prompts.withColumn("no", F.monotonically_increasing_id())
    rows = numbered.select("prompt_type", "prompt", "no", models).select("prompt_type", "prompt", "m.model", (F.col("no") * len(providers) + F.col("m.place")).alias("seq"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waits = Waits(longest_wait_s)
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                got = list(pool.map(lambda m, p: call(providers[m], p, attempts, wait_s, timeout_s, waits, m), pdf["model"], pdf["prompt"]))
                yield pdf.assign(response=[g[0] for g in got], error=[g[1] for g in got])[["model", "prompt_type", "response", "error", "seq"]]

    said = (rows.repartition("model") if tasks is None else rows.repartition(tasks, "seq")).mapInPandas(ask, "model string, prompt_type string, response string, error string, seq long")
    wrapped, message = F.col("model").isin(*payloads) & F.col("error").isNull(), replies.agent_message(F.col("response"))
    error = F.when(wrapped & message.isNull(), "the payload has no message").otherwise(F.col("error"))
    return said.withColumns({"response": F.when(wrapped, message).otherwise(F.col("response")), "error": error}) if payloads else said


def within(provider: Callable[[str], str], prompt: str, timeout_s: float) -> str:
    """The provider's answer; TimeoutError if it takes longer. Its thread can't hold a task: it is left to end by itself."""
    got: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            got.put((provider(prompt), None))
        except Exception as e:  # noqa: BLE001
            got.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        answer, error = got.get(timeout=timeout_s)
    except queue.Empty:
        raise TimeoutError(f"timeout after {timeout_s:g} s") from None
    if error is not None:
        raise error
    return answer


def call(provider: Callable[[str], str], prompt: str, attempts: int, wait_s: float, timeout_s: float = TIMEOUT_S, waits: Waits | None = None, model: str = "") -> tuple[str | None, str | None]:
    for k in range(attempts):
        if waits:
            waits.wait(model)
        try:
            return within(provider, prompt, timeout_s), None
        except Exception as e:  # noqa: BLE001
            error = str(e)
            hopeless = not isinstance(e, TimeoutError) and not any(w in error.lower() for name, words in replies.ERROR_WORDS if name in replies.RETRYABLE for w in words)
            if hopeless or k == attempts - 1:
                return None, error
            said = re.search(replies.RETRY_PATTERN, error)
            if said and waits:
                waits.hold(model, float(said[1]))
            else:
                time.sleep(wait_s * 2**k)
    return None, "no attempt"


ENTRY_SCHEMA = "seq long, model string, entry_no int, what string, why string, how string, files array<string>, commits array<string>, dependencies array<string>, outcome map<string,string>, error string"


def as_entry(table: dict) -> dict:
    """The fields of one entry; KeyError or TypeError if one is missing or of a wrong kind."""
    context = table.get("context", {})
    out = {f: table[f] for f in ("what", "why", "how")} | {f: list(context.get(f, [])) for f in ("files", "commits", "dependencies")} | {"outcome": dict(context.get("outcome", {}))}
    said = [out["what"], out["why"], out["how"], *out["files"], *out["commits"], *out["dependencies"], *out["outcome"].values()]
    if not all(isinstance(x, str) for x in said):
        raise TypeError("an entry's fields have to be text")
    return out


def entries_of(raw: str, strip_fences: bool = False) -> list[dict]:
    """The entries in a reply: ``[[entry]]`` tables (all good or none), else
    blocks between lines of ``---``, of which bad ones are left out if there are
    several; ValueError if there are none."""
    raw = (raw or "").strip()
    if strip_fences and raw.startswith("```"):
        raw = raw.partition("\n")[2].removesuffix("```").strip()
    if raw:
        try:
            if found := [as_entry(t) for t in tomllib.loads(raw).get("entry", [])]:
                return found
        except (ValueError, KeyError, TypeError, AttributeError):
            pass
    blocks = raw.split("\n---\n")
    found = []
    for block in blocks if raw else []:
        try:
            found.append(as_entry(tomllib.loads(block)))
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    if not found:
        raise ValueError("no entry in the reply")
    return found


def parse_responses(answers: DataFrame, strip_fences: bool = False) -> DataFrame:
    """A row per entry in the replies (seq, model, response), or one with ``error`` for a reply without any."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")]
        for pdf in batches:
            out, blank = [], dict.fromkeys(names)
            for seq, model, raw in zip(pdf["seq"], pdf["model"], pdf["response"]):
                try:
                    out += [blank | {"seq": seq, "model": model, "entry_no": i} | e for i, e in enumerate(entries_of(raw, strip_fences))]
                except ValueError as e:
                    out.append(blank | {"seq": seq, "model": model, "error": str(e)})
            yield pd.DataFrame(out, columns=names).astype({"entry_no": "Int32"})

    return answers.select("seq", "model", "response").mapInPandas(parse, ENTRY_SCHEMA)
