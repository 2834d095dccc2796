"""A data source of git commits: ``spark.read.format("git_commits").option("repo", path)``.

Commits come in topological order, oldest first, numbered by ``pos``; numbers
of changed lines are against the first parent. ``since`` leaves out a commit and
what it descends from. The driver lists the hashes once and deals them to tasks,
``commits_per_task`` each (5000 unless set), which read just these commits as
git writes them; so each executor needs the clone, at the same path.

As a stream (``spark.readStream``) it brings each commit once: an offset names
the tip that has been seen, and what can be reached from it is left out of later
batches, also after a rebase.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence
from typing import IO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_FORMAT = "%x01%H%x02%h%x02%P%x02%at%x02%an%x02%ae%x02%B%x03"
SCHEMA = "hash string, short_hash string, parent_hashes array<string>, timestamp long, author string, message string, message_summary string, pos long, deltas array<struct<path:string,insertions:long,deletions:long>>"


def _git(repo: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=600)


Part = tuple[list[str], int]


def tip_of(repo: str) -> str | None:
    """The newest commit's hash, None if there is none; ValueError if ``repo`` is no git repository."""
    if _git(repo, "rev-parse", "--git-dir").returncode:
        raise ValueError(f"not a git repository: {repo}")
    tips = (_git(repo, "rev-parse", "--verify", "-q", f"{r}^{{commit}}") for r in ("HEAD", "refs/heads/main", "refs/heads/master"))
    return next((t.stdout.decode().strip() for t in tips if t.returncode == 0), None)


def parts_between(repo: str, tips: Sequence[str], without: Sequence[str], size: int, before: int = 0) -> list[Part]:
    """(hashes, place of the first) of each task: what ``tips`` reach and ``without`` don't, after ``before`` earlier ones."""
    listed = _git(repo, "rev-list", "--topo-order", "--reverse", *tips, *(f"^{t}" for t in without))
    if listed.returncode:
        raise ValueError(listed.stderr.decode(errors="replace").strip())
    hashes = listed.stdout.decode().split()
    return [(hashes[i : i + size], before + i + 1) for i in range(0, len(hashes), size)]


def parts_of_history(repo: str, since: str | None = None, size: int = 5000) -> list[Part]:
    """The parts of the whole history; ValueError if ``repo`` is no git repository or has no ``since``."""
    tip = tip_of(repo)
    return parts_between(repo, [tip], [since] if since else [], size) if tip else []


def _blocks(pipe: IO[bytes]) -> Iterator[str]:
    rest = b""
    while chunk := pipe.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\x01")
        yield from (x.decode(errors="replace") for x in whole if x)
    if rest:
        yield rest.decode(errors="replace")


def walk(repo: str, hashes: list[str], first: int) -> Iterator[tuple]:
    """Rows of SCHEMA of these commits, in this order, numbered from ``first``."""
    args = ["git", "-C", repo, "log", "--no-walk=unsorted", "--stdin", "--diff-merges=first-parent", "--numstat", "--no-renames", f"--format={_FORMAT}"]
    with subprocess.Popen(args, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as log:
        log.stdin.write("\n".join(hashes).encode() + b"\n")  # git reads all of it before it writes
        log.stdin.close()
        try:
            for pos, block in enumerate(_blocks(log.stdout), first):
                head, _, numbers = block.partition("\x03")
                full, short, parents, at, name, mail, message = head.split("\x02")
                deltas = []
                for line in numbers.strip("\n").split("\n"):
                    if line.count("\t") >= 2:
                        plus, minus, path = line.split("\t", 2)
                        deltas.append((path, int(plus) if plus.isdigit() else 0, int(minus) if minus.isdigit() else 0))
                yield full, short, parents.split(), int(at), f"{name or 'Unknown'} <{mail or 'unknown@example.com'}>", message.rstrip("\n"), message.split("\n", 1)[0].rstrip("\r"), pos, deltas
            if log.wait():
                raise ValueError(f"git log failed in {repo}")
        finally:
            log.kill()


def read_commits(repo: str, since: str | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA; ValueError as ``parts_of_history``."""
    for part in parts_of_history(repo, since):
        yield from walk(repo, *part)


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.since, self.size = options.get("repo"), options.get("since"), int(options.get("commits_per_task") or 5000)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in parts_of_history(self.repo, self.since, self.size) or [None]]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value:
            yield from walk(self.repo, *partition.value)


class _StreamReader(DataSourceStreamReader):
    """An offset names the newest tip. Older ones that this reader has met are kept in mind as well."""

    def __init__(self, options):
        self.repo, self.size = options.get("repo"), int(options.get("commits_per_task") or 5000)
        self.met: list[str] = []

    def initialOffset(self) -> dict:
        return {"tip": ""}

    def latestOffset(self) -> dict:
        return {"tip": tip_of(self.repo) or ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.met += [t for t in (start["tip"],) if t and t not in self.met]
        # git drops commits that nothing refers to after some weeks
        there = [t for t in self.met if _git(self.repo, "cat-file", "-e", f"{t}^{{commit}}").returncode == 0]
        new = parts_between(self.repo, [end["tip"]], there, self.size) if end["tip"] else []
        total = int(_git(self.repo, "rev-list", "--count", end["tip"]).stdout) if new else 0
        before = total - sum(len(h) for h, _ in new)  # places are those in the whole history
        return [InputPartition((h, first + before)) for h, first in new] or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value:
            yield from walk(self.repo, *partition.value)
