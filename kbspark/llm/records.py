"""Token ids in binary record files, with an offset index beside them.

A file is a row of frames, each

    length      8 bytes, little-endian: bytes of the payload
    check       4 bytes: masked CRC-32 of the length
    payload     1 byte flags (1: the id is set), 8 bytes id, 1 byte width of an
                id of a token, then the ids
    check       4 bytes: masked CRC-32 of the payload

The mask rotates a checksum right by 15 bits and adds a constant, so that a
checksum of data which holds checksums stays sound. Files are written in
ascending order of the documents' ids: documents are dealt to tasks by ranges
of ids and sorted there. A task's file has a name of its own for each attempt;
the index, a Parquet table written by Spark's committer, names only the files
of the attempts that ended well.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import tokens
from kbspark.llm.common import batch_of, fresh_path

#: Fixed value: the constant of the checksum's mask.
MASK_DELTA = 0xA282EAD8
INDEX_SCHEMA = "part int, file string, doc_id long, n_tokens long, within long, offset long, length long"
RECORDS_SCHEMA = "doc_id long, part int, within long, n_tokens long, ids binary, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, width: int, ids: bytes) -> bytes:
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> tuple[int | None, np.ndarray]:
    """The id and token ids of one frame; ValueError if a checksum is wrong."""
    (n,), (head_check,) = struct.unpack_from("<Q", data), struct.unpack_from("<I", data, 8)
    if head_check != masked(data[:8]) or len(data) != n + 16:
        raise ValueError("a frame's length is damaged")
    payload = data[12 : 12 + n]
    if struct.unpack_from("<I", data, 12 + n)[0] != masked(payload):
        raise ValueError("a frame's payload is damaged")
    known, doc_id, width = struct.unpack_from("<BqB", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=10)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of each document and ``end_id``; returns the stored index.

    The index has a row per document: part, file, doc_id, n_tokens, within (ids
    before it in its file), offset and length (of its frame). A null or empty
    text is the end id alone; null ids come first; repeated rows are written
    each; an empty table gives an empty index. Other columns are left out.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.load(tokenizer), TaskContext.get().partitionId()
        out, offset, within = None, 0, 0
        file = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        end = np.array([end_id], enc.dtype).tobytes()
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    ids, rows = batch.column(0)[i : i + 512].to_pylist(), []
                    for doc_id, packed in zip(ids, enc.encode(batch.column(1)[i : i + 512].to_pylist())):
                        data = frame(doc_id, enc.width, packed + end)
                        if out is None:
                            store, where = _open(file)
                            store.create_dir(where.rpartition("/")[0], recursive=True)
                            out = store.open_output_stream(where)
                        out.write(data)
                        n = len(packed) // enc.width + 1
                        rows.append((part, file, doc_id, n, within, offset, len(data)))
                        offset, within = offset + len(data), within + n
                    yield batch_of(rows, INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the frames that ``index`` names, in any subset or order: doc_id,
    part, within, n_tokens, ids (unsigned 32-bit little-endian), ids_crc32.

    Each file is read by one task in the order of offsets; frames that the
    index leaves out are skipped. Damaged frames raise an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, src = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(i, 512).to_pylist():
                    if r["file"] != name:
                        if src is not None:
                            src.close()
                        store, where = _open(name := r["file"])
                        src = store.open_input_file(where)
                    data = src.read_at(r["length"], r["offset"])
                    doc_id, ids = unframe(data)
                    ids = ids.astype("<u4").tobytes()
                    rows.append((doc_id, r["part"], r["within"], len(ids) // 4, ids, zlib.crc32(ids)))
                yield batch_of(rows, RECORDS_SCHEMA)
        if src is not None:
            src.close()

    files = (index.agg(F.max("part")).first()[0] or 0) + 1
    return index.select("file", "part", "within", "offset", "length").repartitionByRange(files, "part", "file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS_SCHEMA)


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Add start: ids of all documents before, over all files in order."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("part", before.alias("base"))
    return records.join(base, "part").withColumn("start", F.col("base") + F.col("within")).drop("base")
