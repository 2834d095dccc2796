"""Classing what model calls leave behind: errors, retry hints, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.functions.rules import first_hit

# Error words in the order in which they are tried, the classes that a retry can help, and the pattern
# that finds how long to wait (RETRY_PATTERN).
ERROR_WORDS = (
    ("rate_limit", ("429", "rate limit", "quota exceeded")),
    ("auth", ("unauthorized", "authentication", "401")),
    ("unavailable", ("503", "unavailable")),
)
RETRYABLE = ("rate_limit", "unavailable", "timeout")
FATAL = ("auth", "not_installed", "config")
SNIPPET_CHARS = 200
RETRY_PATTERN = r"(?i)retry[- ]after:?\s*(\d+)"


def error_class(stderr: Column) -> Column:
    return first_hit(F.lower(stderr), ERROR_WORDS, "request_failed")


def is_retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


def is_fatal(kind: Column) -> Column:
    return kind.isin(*FATAL)


def failure_message(kind: Column, model: Column, detail: Column) -> Column:
    """What a person is told of a failure of ``kind``."""
    said = {
        "rate_limit": "%s takes no more requests for now: %s", "auth": "%s does not accept the credentials: %s", "unavailable": "%s cannot be reached: %s",
        "timeout": "%s did not answer in time: %s", "not_installed": "%s is not installed: %s", "config": "%s is not set up: %s",
    }
    out = F.format_string("%s failed: %s", model, detail)
    for name, form in said.items():
        out = F.when(kind == name, F.format_string(form, model, detail)).otherwise(out)
    return out


def retry_after(stderr: Column) -> Column:
    """Seconds that a message asks to wait, null if it doesn't."""
    return F.regexp_extract(stderr, RETRY_PATTERN, 1).try_cast("long")


def agent_message(payload: Column) -> Column:
    """The reply in a JSON payload; null if the payload is no JSON or lacks it."""
    return F.get_json_object(payload, "$.agent_message")


def snippet(text: Column) -> Column:
    return F.left(text, F.lit(SNIPPET_CHARS))
