"""The files of a repository as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text
from kbspark.functions.ignore import IgnoreRules

#: Levels of folders that are listed one by one, so that what is below them is dealt to tasks.
LEVELS = 2


def repo_files(spark: SparkSession, root: str, kb_dir: str = ".kb", gitignore: bool = True) -> DataFrame:
    """path (below ``root``), hash, size, text of every file that isn't binary,
    left out by a ``.gitignore`` of its folder or one above it, or in ``.git`` or the knowledge folder.

    Tasks list the folders, after ``LEVELS`` levels each with all that is below
    it, and read the contents; ignored folders are not entered. Ignore files are
    read with the folders, on any store. (Spark's own file source passes over names with a
    leading dot, which a code base has.)
    """

    def listed(folders: DataFrame, recursive: bool) -> DataFrame:
        """What lies in ``folders``; each row has the ignore files of the folders above it (``rules``, JSON by folder)."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(root)
            base = base.rstrip("/")
            for batch in batches:
                out: list[tuple[str, bool, str | None]] = []
                todo: list[tuple[str, str | None]] = []
                for path, is_dir, rules in zip(*(c.to_pylist() for c in batch.columns)):
                    if is_dir:
                        todo.append((path, rules))
                    else:
                        out.append((path, False, None))
                while todo:
                    folder, rules = todo.pop()
                    found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                    kinds = {i.path[len(base) + 1 :]: i.type == fs.FileType.Directory for i in found if i.base_name not in (".git", kb_dir)}
                    here = f"{folder}/.gitignore".lstrip("/")
                    if gitignore and kinds.get(here) is False:
                        with store.open_input_file(f"{base}/{here}") as f:
                            rules = json.dumps(json.loads(rules or "{}") | {folder: f.read().decode(errors="replace")})
                    known = IgnoreRules(json.loads(rules or "{}"))
                    known.folders[folder] = False
                    for path, is_dir in kinds.items():
                        if not known.ignores(path, is_dir):
                            if is_dir and recursive:
                                todo.append((path, rules))
                            else:
                                out.append((path, is_dir, rules if is_dir else None))
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())], names=["path", "is_dir", "rules"])

        return folders.mapInArrow(step, "path string, is_dir boolean, rules string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, top = fs.FileSystem.from_uri(root)
        for pdf in batches:
            bodies = []
            for p in pdf["path"]:
                with here.open_input_file(f"{top.rstrip('/')}/{p}") as f:
                    bodies.append(f.read())
            yield pdf.assign(content=bodies)

    names = spark.createDataFrame([("", True, None)], "path string, is_dir boolean, rules string").coalesce(1)
    for level in range(LEVELS + 1):
        names = listed(names, recursive=level == LEVELS).repartition("path")
    rows = names.select("path").mapInPandas(read, "path string, content binary").where(~text.looks_binary(F.col("content")))
    return rows.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"), F.col("content").cast("string").alias("text"))
