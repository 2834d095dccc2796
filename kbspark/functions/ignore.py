"""Rules of ignore files (``.gitignore``), compiled and looked up by folder."""

from __future__ import annotations

import re
from typing import NamedTuple

# The named classes of characters that patterns know.
_CLASSES = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "blank": r" \t", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": r"\x21-\x7e", "lower": "a-z",
    "print": r"\x20-\x7e", "punct": r"!-/:-@\[-`{-~", "space": r" \t\n\r\x0b\x0c", "upper": "A-Z", "xdigit": "0-9a-fA-F",
}


class Rule(NamedTuple):
    regex: re.Pattern
    keeps: bool  # the line begins with an exclamation mark
    folders_only: bool
    whole: bool  # it names a path below its folder, not a name anywhere below


def _class(p: str, i: int) -> tuple[str, int] | None:
    """The regex of the bracket expression at ``p[i]``, and where it ends; None if it doesn't."""
    j, negated = i + 1, False
    if p[j : j + 1] in ("!", "^"):
        negated, j = True, j + 1
    parts, first = [], True
    while j < len(p) and (first or p[j] != "]"):
        first = False
        if p.startswith("[:", j) and (end := p.find(":]", j)) > 0:
            if p[j + 2 : end] not in _CLASSES:
                return None
            parts.append(_CLASSES[p[j + 2 : end]])
            j = end + 2
            continue
        ends = []
        while True:  # one character, or two with a hyphen between
            if p[j : j + 1] == "\\":
                j += 1
            if j >= len(p):
                return None
            ends.append(p[j])
            j += 1
            if len(ends) == 2 or p[j : j + 1] != "-" or p[j + 1 : j + 2] in ("", "]"):
                break
            j += 1
        parts.append("-".join(map(re.escape, ends if ends[0] <= ends[-1] else ends[:1])))  # a range's first character always counts
    if j >= len(p):
        return None
    body = "".join(parts)
    if not body:
        return ("[^/]" if negated else "(?!)"), j + 1
    return f"(?!/)[{'^' if negated else ''}{body}]", j + 1


def _regex(p: str) -> str | None:
    """A pattern as a regex; None if it can match nothing."""
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if c == "*":
            j = i
            while p[j : j + 1] == "*":
                j += 1
            if j - i > 1 and (i == 0 or p[i - 1] == "/") and p[j : j + 1] in ("", "/"):  # a whole part of the path
                if j == len(p):
                    out.append(".+" if i else ".*")
                else:
                    out.append("(?:.*/)?")
                    j += 1
            else:
                out.append("[^/]*")
            i = j
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            found = _class(p, i)
            if found is None:
                return None
            out.append(found[0])
            i = found[1]
        elif c == "\\":
            if i + 1 == len(p):
                return None
            out.append(re.escape(p[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def _bytes(text: str) -> str:
    return text.encode().decode("latin-1")


def compile_line(line: str) -> Rule | None:
    """One line of an ignore file; None if it is blank, a comment or matches nothing.
    Patterns see bytes: one that stands for a character stands for one byte."""
    line = _bytes(line)
    line = line.removesuffix("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[1:] if keeps else line
    folders_only = line.endswith("/")
    line = line[:-1] if folders_only else line
    whole = "/" in line
    body = _regex(line.removeprefix("/"))
    if not line or body is None:
        return None
    return Rule(re.compile(body, re.DOTALL), keeps, folders_only, whole)


class IgnoreRules:
    """Which paths are ignored by the ignore files of the folders above them.

    Rules of deeper folders come before those of higher ones, and later lines
    before earlier ones. What lies in an ignored folder is ignored, whatever else
    is said of it.
    """

    def __init__(self, files: dict[str, str]):
        """``files``: the content of the ignore file in each folder ("" is the top)."""
        self.rules = {folder: [r for line in content.split("\n") if (r := compile_line(line))] for folder, content in files.items()}
        self.folders: dict[str, bool] = {"": False}

    def _says(self, path: str, is_folder: bool) -> bool:
        folder = path.rpartition("/")[0]
        while True:
            for rule in reversed(self.rules.get(folder, ())):
                if rule.folders_only and not is_folder:
                    continue
                below = _bytes(path[len(folder) + 1 if folder else 0 :])
                if rule.regex.fullmatch(below if rule.whole else below.rpartition("/")[2]):
                    return not rule.keeps
            if not folder:
                return False
            folder = folder.rpartition("/")[0]

    def ignores(self, path: str, is_folder: bool = False) -> bool:
        above = path.rpartition("/")[0]
        if above not in self.folders:
            self.folders[above] = self.ignores(above, True)
        return self.folders[above] or self._says(path, is_folder)
