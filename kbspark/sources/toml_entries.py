"""Knowledge entries as TOML files, one folder per category."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.prompts import as_entry

SCHEMA = "category string, file_name string, what string, why string, how string, files array<string>, commits array<string>, dependencies array<string>, outcome map<string,string>"


def parse_entry(body: bytes) -> dict | None:
    """The fields of one file, None if it isn't a good entry."""
    try:
        return as_entry(tomllib.loads(body.decode()))
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def read_entries(spark: SparkSession, root: str, glob: str = "*.toml") -> DataFrame:
    """All entries below ``root`` at any depth; files that can't be read as one are left out.
    The category is the folder that a file lies in."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    rows = raw.select(F.element_at(parts, -2).alias("category"), F.element_at(parts, -1).alias("file_name"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(c, f, e) for c, f, b in zip(pdf["category"], pdf["file_name"], pdf["content"]) if (e := parse_entry(bytes(b)))]
            yield pd.DataFrame([{"category": c, "file_name": f} | e for c, f, e in found], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInPandas(parse, SCHEMA)


def to_toml(entry: dict) -> str:
    """One entry as TOML; empty lists and outcomes are left out.

    >>> print(to_toml({"what": "a", "why": "b", "how": "c", "files": ["x"]}))
    what = "a"
    why = "b"
    how = "c"
    <BLANKLINE>
    [context]
    files = ["x"]
    <BLANKLINE>
    """
    quote = lambda s: json.dumps(s, ensure_ascii=False).replace("\x7f", "\\u007f")  # noqa: E731  JSON's escapes are TOML's
    out = [f"{f} = {quote(entry[f])}" for f in ("what", "why", "how")]
    lists = [f"{f} = [{', '.join(map(quote, entry[f]))}]" for f in ("files", "commits", "dependencies") if entry.get(f)]
    outcome = [f"{quote(k)} = {quote(v)}" for k, v in sorted((entry.get("outcome") or {}).items())]
    if lists or outcome:
        out += ["", "[context]", *lists]
    if outcome:
        out += ["", "[context.outcome]", *outcome]
    return "\n".join(out) + "\n"


def write_entries(entries: DataFrame, root: str) -> None:
    """A file per entry (category, slug, ...) below ``root``, moved to its place when all are written; other files stay."""
    from kbspark.sources import entry_source

    entry_source.register(entries.sparkSession)
    entries.write.format("kb_entries").mode("append").save(root)
