"""Lines that are inserted and deleted between two snapshots of files.

The numbers are those of a shortest edit script, that is of a longest common
subsequence of lines. Common lines at both ends and lines that one side alone
has are set aside first. Myers' greedy search, which remembers one front of
furthest reaching paths, is fast where few lines differ. Where many do, it is
given up for counting along bit vectors, whose work depends on the lengths
alone; the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of bit vectors that are kept for lines that come again.
KEPT_BYTES = 128 << 20


def lines_of(content: bytes) -> list[bytes]:
    """Lines with their ends, so that a last one without differs from one with it."""
    *whole, rest = content.split(b"\n")
    return [x + b"\n" for x in whole] + ([rest] if rest else [])


def _greedy(a: list[int], b: list[int], most: int) -> int | None:
    """How many insertions and deletions lead from ``a`` to ``b``; None beyond ``most``."""
    n, m = len(a), len(b)
    reach = {1: 0}
    for d in range(most + 1):
        now = {}
        for k in range(-d, d + 1, 2):  # diagonals: insertions less than deletions by k
            x = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach.get(k - 1, -1) + 1
            y = x - k
            while 0 <= x < n and 0 <= y < m and a[x] == b[y]:
                x += 1
                y += 1
            now[k] = x
            if x >= n and y >= m:
                return d
        reach = now
    return None


def _common(a: list[int], b: list[int]) -> int:
    """The length of a longest common subsequence, one bit for each item of ``a`` and one step for each of ``b``."""
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    full = (1 << len(a)) - 1
    row, kept, room = full, {}, KEPT_BYTES * 8 // max(1, len(a))
    for y in b:
        mask = kept.get(y)
        if mask is None:
            bits = bytearray(len(a) // 8 + 1)
            for i in at.get(y, ()):
                bits[i >> 3] |= 1 << (i & 7)
            mask = int.from_bytes(bits, "little")
            if len(kept) < room:
                kept[y] = mask
        met = row & mask
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def changed_lines(before: bytes | None, after: bytes | None) -> tuple[int, int]:
    """(insertions, deletions); a missing side has no lines."""
    a, b = lines_of(before or b""), lines_of(after or b"")
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    ids: dict[bytes, int] = {}
    x, y = ([ids.setdefault(line, len(ids)) for line in side] for side in (a, b))
    both = set(x) & set(y)
    x, y = [i for i in x if i in both], [i for i in y if i in both]
    most = math.isqrt(7 * len(y) * (1 + len(x) // 16_000)) + 64  # where its steps take as long as those along bit vectors
    d = _greedy(x, y, min(most, len(x) + len(y)))
    common = (len(x) + len(y) - d) // 2 if d is not None else _common(x, y)
    return len(b) - common, len(a) - common


def content_diffs(before: DataFrame, after: DataFrame, window: int = 512) -> DataFrame:
    """path, insertions, deletions, is_binary of every path whose content (path, content) differs.

    A path that one side lacks, or has a null content for, counts with all its
    lines. Files with a zero byte in their first ``window`` bytes are binary and count none. Contents are exchanged
    only for paths whose hashes differ. One row per path is expected on either side; more meet all of the other.
    """
    hashed = lambda df, name: df.where("path is not null").select("path", F.sha2(F.col("content").cast("binary"), 256).alias(name))
    differ = hashed(before, "old").join(hashed(after, "new"), "path", "full").where("NOT old <=> new").select("path").distinct()
    side = lambda df, name: df.join(differ, "path", "left_semi").select("path", F.col("content").cast("binary").alias(name))
    schema = pa.schema([("path", pa.string()), ("insertions", pa.int64()), ("deletions", pa.int64()), ("is_binary", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(i, 256).to_pylist():
                    binary = any(0 in (r[s] or b"")[:window] for s in ("old", "new"))
                    plus, minus = (0, 0) if binary else changed_lines(r["old"], r["new"])
                    out.append({"path": r["path"], "insertions": plus, "deletions": minus, "is_binary": binary})
                yield pa.RecordBatch.from_pylist(out, schema)

    pairs = side(before, "old").join(side(after, "new"), "path", "full")
    return pairs.select("path", "old", "new").mapInArrow(run, "path string, insertions long, deletions long, is_binary boolean")
