"""Text functions; each takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_space(c: Column) -> Column:
    """Without white space of any kind at either end; Spark's own trim takes blanks alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return trim_space(F.coalesce(c, F.lit(""))) == ""


def contains_any(c: Column, tokens) -> Column:
    """Whether one of the literal ``tokens`` occurs in ``c``, as a part of a word or not."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in tokens))


def contains_ignoring_case(c: Column, query: str) -> Column:
    """Literal search; an empty query is found everywhere, also in a null."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))


def slugify(c: Column, limit: int = 50) -> Column:
    """Lower case, runs of other than letters and digits as one hyphen, none at
    the ends; beyond ``limit`` characters cut back to the last hyphen before."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")
    head = F.left(plain, F.lit(limit))
    cut = F.when(F.contains(head, F.lit("-")), F.regexp_extract(head, "^(.*)-[^-]*$", 1)).otherwise(head)
    return F.when(F.char_length(plain) > limit, F.regexp_replace(cut, "-+$", "")).otherwise(plain)


def sentences(c: Column) -> Column:
    """The parts between full stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[.]"), trim_space), lambda x: x != "")


def lines(c: Column) -> Column:
    """Lines without their ends; a last one that is empty doesn't count."""
    parts = F.split(c, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty if only a leading dot has it or none is there."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def summary(message: Column) -> Column:
    return F.regexp_replace(F.split_part(message, F.lit("\n"), F.lit(1)), "\r$", "")


def author(name: Column, email: Column) -> Column:
    return F.format_string("%s <%s>", F.coalesce(name, F.lit("Unknown")), F.coalesce(email, F.lit("unknown@example.com")))


def parent_dir(path: Column, default: str = "unknown") -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(default))


def relative(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)


def looks_binary(content: Column, window: int = 512) -> Column:
    """Whether one of the first bytes is zero."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, window)) > 0
