"""Exact de-duplication by Grace hashing.

Every task first folds equal texts of its own input in an open-addressing table of bounded size, so a
text that a third of all rows share leaves each task once. Spark's shuffle by content digest is the
first partitioning; a task whose bucket exceeds the table's memory goes on partitioning it by further
hash bits into spill files until each bucket fits. The table compares complete contents, never digests
alone. The members then look their group up by digest in a plain equi-join, whose hot keys adaptive
execution splits.

Defined results: null text counts as empty. Texts are equal when identical after lower-casing A-Z. The
row with the largest doc_id stays; rows that repeat that doc_id are indistinguishable and all marked
kept. A null doc_id never wins over a number; a group of null ids only has a null keep_id and is kept.
Spill files are private to the task that writes them and gone when it ends, like Spark's own sort
spill; a task that is run again elsewhere starts afresh. An empty table gives no rows. A text longer than a
table has room for is a table of its own. Only doc_id and text are read; ``deduplicated`` keeps all other
columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free_names, steps, texts_of

LOCAL_BYTES = 24 << 20
TABLE_BYTES = 64 << 20
FAN_OUT = 16
_HEAD = struct.Struct("<32s?qqI")


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete contents are equal."""

    def __init__(self, most: int):
        self.most, self.used = most, 0
        self.slots = [-1] * 1024
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def find(self, digest: bytes, content: bytes) -> int:
        """The entry's number, or -1 - slot where it would go."""
        mask = len(self.slots) - 1
        slot = int.from_bytes(digest[-8:], "little") & mask
        while (entry := self.slots[slot]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                return entry
            slot = (slot + 1) & mask
        return -1 - slot

    def add(self, digest: bytes, content: bytes, doc_id: int | None, count: int) -> bool:
        """False if the content is new and the table is full."""
        entry = self.find(digest, content)
        if entry >= 0:
            if doc_id is not None and (self.ids[entry] is None or doc_id > self.ids[entry]):
                self.ids[entry] = doc_id
            self.counts[entry] += count
            return True
        if self.contents and self.used + len(content) + 200 > self.most:
            return False
        self.slots[-1 - entry] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.ids.append(doc_id)
        self.counts.append(count)
        self.used += len(content) + 200
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            slot = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[bytes]]]:
    for part, data, off in steps(batches, "text"):
        texts = [x.translate(ASCII_LOWER) for x in texts_of(data, off)]
        yield part.column("doc_id").to_pylist(), texts, [hashlib.sha256(x).digest() for x in texts]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, digests in _normal(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def _flushed(table: ContentTable) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(table.contents), 512):
        cut = slice(at, at + 512)
        yield pa.RecordBatch.from_arrays(
            [pa.array(table.digests[cut], pa.binary()), pa.array(table.contents[cut], pa.binary()), pa.array(table.ids[cut], pa.int64()), pa.array(table.counts[cut], pa.int64())],
            ["digest", "content", "doc_id", "n"],
        )


def _fold_local(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(most)
        for rows in _normal(batches):
            for doc_id, text, digest in zip(*rows):
                if not table.add(digest, text, doc_id, 1):
                    yield from _flushed(table)
                    table = ContentTable(most)
                    table.add(digest, text, doc_id, 1)
        yield from _flushed(table)

    return run


def _records(file) -> Iterator[tuple[bytes, bytes, int | None, int]]:
    file.seek(0)
    while head := file.read(_HEAD.size):
        digest, known, doc_id, count, size = _HEAD.unpack(head)
        yield digest, file.read(size), doc_id if known else None, count


def grace(records, most: int, level: int = 0) -> Iterator[ContentTable]:
    """Tables that together hold each distinct content once. What a full table doesn't hold goes to FAN_OUT files by the level's hash bits."""
    table = ContentTable(most)
    with ExitStack() as stack:
        files = []
        for digest, content, doc_id, count in records:
            if table.add(digest, content, doc_id, count):
                continue
            if not files:
                files = [stack.enter_context(tempfile.TemporaryFile()) for _ in range(FAN_OUT)]
            bucket = (digest[level // 2 % 24] >> 4 * (level % 2)) & 15
            files[bucket].write(_HEAD.pack(digest, doc_id is not None, doc_id or 0, count, len(content)))
            files[bucket].write(content)
        yield table
        del table
        for file in files:
            if file.tell():
                yield from grace(_records(file), most, level + 1)
            file.close()


def _groups(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield from zip(*(part.column(c).to_pylist() for c in ("digest", "content", "doc_id", "n")))

        for table in grace(records(), most):
            if len(set(table.digests)) < len(table.digests):
                raise RuntimeError("two contents share a SHA-256 digest")
            for at in range(0, len(table.digests), 8192):
                cut = slice(at, at + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(table.digests[cut], pa.binary()), pa.array(table.ids[cut], pa.int64()), pa.array(table.counts[cut], pa.int64())], ["digest", "keep_id", "group_size"])

    return run


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", local_bytes: int = LOCAL_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Other columns of ``docs`` are not read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    folded = rows.mapInArrow(_fold_local(local_bytes), "digest binary, content binary, doc_id long, n long")
    groups = folded.repartition("digest").mapInArrow(_groups(table_bytes), "digest binary, keep_id long, group_size long")
    members = rows.mapInArrow(_members, "doc_id long, digest binary")
    return members.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns untouched (rows that repeat the id and text that stay all do)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    kept_id, kept_sha = free_names(docs.columns, "kept_id", "kept_sha")
    keep = exact_groups(docs, doc_id=doc_id, text=text).where("kept").select(F.col("keep_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    digest = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower).cast("binary"), 256)
    return docs.join(keep, F.col(doc_id).cast("long").eqNullSafe(F.col(kept_id)) & (digest == F.col(kept_sha)), "left_semi")
