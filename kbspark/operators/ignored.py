"""Which paths of a table ignore files leave out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.ignore import IgnoreRules

#: Rules are broadcast; more bytes of them are an error.
MOST_BYTES = 64 << 20


def ignored_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``files`` (path) that the ignore files ``rules`` (folder, content; "" is the
    top) leave out. Paths with a slash at the end are folders. A null path is not ignored; of several rows of a
    folder the lines count one after the other, in the order of their contents."""
    size = rules.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"ignore files of {size} bytes are more than {MOST_BYTES}")
    contents: dict[str, list[str]] = {}
    for r in rules.where("folder is not null and content is not null").orderBy("folder", "content").collect():
        contents.setdefault(r.folder.strip("/"), []).append(r.content)
    shared = files.sparkSession.sparkContext.broadcast({f: "\n".join(c) for f, c in contents.items()})

    @F.pandas_udf("boolean")
    def hidden(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:  # sees paths alone, whatever else the rows hold
        known = IgnoreRules(shared.value)
        for paths in batches:
            if len(known.folders) > 100_000:
                known.folders = {"": False}
            yield pd.Series([isinstance(p, str) and known.ignores(p.rstrip("/"), p.endswith("/")) for p in paths], dtype=bool)

    return files.where(hidden("path"))
