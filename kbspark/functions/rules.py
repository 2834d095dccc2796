"""Rule tables: the weights and words by which entries and commits are classed.

All of them are parameters of the operators; these are the defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import contains_any

# They decide results and have to be just these.
CATEGORIES = ("decisions", "migrations", "bugs", "patterns", "facts")
CATEGORY_WEIGHTS = {"decisions": 3.0, "patterns": 2.5, "bugs": 2.0, "migrations": 1.5, "facts": 1.0}
OTHER_WEIGHT = 0.5
FIELD_WEIGHTS = {"what": 10.0, "why": 5.0, "how": 3.0}
ENTRY_WORDS = (
    ("migrations", ("migrat", "upgrade", "schema")),
    ("bugs", ("bug", "fix", "patch")),
    ("patterns", ("pattern", "convention", "standard")),
    ("decisions", ("decid", "chose", "adopt", "decision")),
)
COMMIT_WORDS = (("migration", ("migrat", "schema", "upgrade")), ("bug", ("fix", "bug", "patch")))
MODEL_TENTHS = {"claude": 12, "gemini": 11, "codex": 10}
OTHER_MODEL_TENTHS = 10
MAJORITY_TENTHS = 20
PATH_RULES = {
    "migrations/": 1.0, "schema/": 1.0, "core/": 1.0, "lib/fundamentals/": 1.0, "security/": 1.0,
    "src/": 0.8, "app/models/": 0.8, "app/controllers/": 0.8, "config/": 0.8,
    "tests/": 0.5, "specs/": 0.5, "test/": 0.5, "spec/": 0.5, "docs/architecture/": 0.5,
    "docs/": 0.3, "README": 0.3, "examples/": 0.3,
    ".gitignore": 0.1, ".editorconfig": 0.1,
}
MESSAGE_RULES = {
    "breaking change": 1.0, "security fix": 1.0, "cve-": 1.0, "vulnerability": 1.0,
    "refactor": 0.8, "architecture": 0.8, "migration": 0.8, "deprecate": 0.8,
    "feature": 0.6, "enhancement": 0.6, "optimize": 0.6, "performance": 0.6,
    "fix": 0.4, "bug": 0.4, "update": 0.4,
    "typo": 0.2, "whitespace": 0.2, "formatting": 0.2, "docs": 0.2,
}
SCORE_WEIGHTS = {"diff": 0.3, "pattern": 0.4, "message": 0.3}
DOC_EXTENSIONS = ("md", "txt", "rst")


def first_hit(text: Column, ladder: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rung of ``ladder`` one of whose words is in ``text``."""
    out = F.lit(default)
    for label, tokens in reversed(ladder):
        out = F.when(contains_any(text, tokens), label).otherwise(out)
    return out


def infer_category(what: Column, why: Column, how: Column) -> Column:
    return first_hit(F.lower(F.concat_ws(" ", what, why, how)), ENTRY_WORDS, "facts")


def infer_commit_category(summary: Column) -> Column:
    return first_hit(F.lower(summary), COMMIT_WORDS, "decision")


def weight_of(key: Column, weights: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, w in weights.items():
        out = F.when(key == k, w).otherwise(out)
    return out


def best_rule(text: Column, rules: Mapping[str, float]) -> tuple[Column, Column]:
    """(hundredths, token) of the heaviest rule whose token is in ``text``, the
    alphabetically first of equals; (0, null) if there is none. Unrolled into
    one expression, so that no join is needed."""
    hundredths, token = F.lit(0), F.lit(None).cast("string")
    for t, w in sorted(sorted(rules.items(), reverse=True), key=lambda x: x[1]):  # what comes later counts
        hit = F.contains(text, F.lit(t))
        hundredths, token = F.when(hit, round(w * 100)).otherwise(hundredths), F.when(hit, t).otherwise(token)
    return hundredths, token


#: Rules of a table are broadcast as one automaton; more characters of them are an error.
MOST_CHARS = 64 << 20


def table_rule(rules: DataFrame) -> Callable[[Column], tuple[Column, Column]]:
    """``best_rule`` for rules (token, weight) that a table holds, however many: all tokens
    are looked for in one pass over a text. Of rows with one token the heaviest counts;
    rows with a null are left out."""
    import ahocorasick

    known = rules.where("token is not null and weight is not null").groupBy("token").agg(F.max("weight").alias("weight"))
    size = known.agg(F.sum(F.char_length("token"))).first()[0] or 0
    if size > MOST_CHARS:
        raise ValueError(f"rules of {size} characters are more than {MOST_CHARS}")
    rows = [(r.token, round(r.weight * 100)) for r in known.collect()]
    words = ahocorasick.Automaton()
    for t, h in rows:
        if t:
            words.add_word(t, (-h, t))
    words.make_automaton()
    always = [(-h, t) for t, h in rows if not t]
    shared = rules.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("h int, t string")
    def best(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            hits = () if text is None or not len(shared.value) else (x for _, x in shared.value.iter(text))
            found.append(min([*(always if text is not None else ()), *hits], default=(0, None)))
        return pd.DataFrame({"h": [-h for h, _ in found], "t": [t for _, t in found]}).astype({"t": object})

    def rule(text: Column) -> tuple[Column, Column]:
        hit = best(text)
        return F.coalesce(hit["h"], F.lit(0)), hit["t"]

    return rule
