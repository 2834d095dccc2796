"""Knowledge entries as a data source: ``spark.read.format("kb_entries").load(root)``.

Filters on category and file name are pushed down: files of other folders and
names are listed, as Spark lists them for its own sources, but never opened.
Tasks get files of about ``bytes_per_task`` together.

Writing goes through a staging folder. Tasks write there, and only when all of
them have succeeded are their files moved to their places, each at once; a
failed job leaves the old files, and what a failed or repeated attempt has
written goes with the staging folder. Rows name their file by ``file_name``
or ``slug``; ``append`` replaces files of the same names, ``overwrite`` all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from kbspark.sources.toml_entries import SCHEMA, parse_entry, to_toml

_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_STAGING = ".staging-"


def _store(root: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(root)
    return store, base.rstrip("/")


class EntryReader(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root, size
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("category",), ("file_name",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.only[name] = self.only[name] & values if name in self.only else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, base = _store(self.root)
        parts: list[list[str]] = []
        room = 0
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        for info in sorted(found, key=lambda i: i.path):
            path = info.path[len(base) + 1 :]
            *folders, name = path.split("/")
            if info.type != fs.FileType.File or not name.endswith(".toml") or any(f.startswith(_STAGING) for f in folders):
                continue
            place = {"category": folders[-1] if folders else base.rpartition("/")[2], "file_name": name}
            if all(place[c] in values for c, values in self.only.items()):
                if not parts or room < info.size:
                    parts.append([])
                    room = self.size
                parts[-1].append(path)
                room -= info.size
        return [InputPartition(p) for p in parts] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, base = _store(self.root)
        for path in partition.value:
            with store.open_input_file(f"{base}/{path}") as f:
                entry = parse_entry(f.read())
            if entry:
                folders, _, name = f"{base}/{path}".rpartition("/")
                row = {"category": folders.rpartition("/")[2], "file_name": name} | entry
                yield tuple(row[c] for c in _NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # in the staging folder, and where they belong


class EntryWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.staging = root, overwrite, f"{_STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, base = _store(self.root)
        attempt, files = uuid.uuid4().hex, {}
        for n, row in enumerate(iterator):
            r = row.asDict(recursive=True)
            name = r["file_name"] if r.get("file_name") else f"{r['slug']}.toml"
            staged = f"{self.staging}/{attempt}/{n}.toml"
            store.create_dir(f"{base}/{self.staging}/{attempt}", recursive=True)
            with store.open_output_stream(f"{base}/{staged}") as f:
                f.write(to_toml(r).encode())
            files[f"{r['category']}/{name}"] = staged
        return Written([(staged, place) for place, staged in files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.root)
        places = set()
        for message in messages:
            for staged, place in message.files if message else ():
                store.create_dir(f"{base}/{place.rpartition('/')[0]}", recursive=True)
                store.move(f"{base}/{staged}", f"{base}/{place}")
                places.add(f"{base}/{place}")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path.endswith(".toml") and info.path not in places and _STAGING not in info.path:
                    store.delete_file(info.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, base = _store(self.root)
        if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.staging}")


class KbEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kb_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EntryReader:
        return EntryReader(self.options["path"], int(self.options.get("bytes_per_task") or 8 << 20))

    def writer(self, schema, overwrite: bool) -> EntryWriter:
        return EntryWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``kb_entries`` known, and let Spark push filters down to it."""
    spark.dataSource.register(KbEntries)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
