"""Exact deduplication by a Grace hash over complete contents."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import LOWER_AZ, written

#: Bytes of contents and ids that one table may hold before its records are partitioned further.
TABLE_BYTES = 48 << 20
#: Hash bits that one level of spill files uses.
LEVEL_BITS = 4


class ContentTable:
    """Open addressing with linear probing; a slot is taken as equal only if the complete contents are equal."""

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.slots = array("q", [-1]) * 1024
        self.bytes = 0

    def place(self, h: int, content: bytes) -> int:
        """The entry of this content, made if it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _combined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """One fold for each content of a stretch of rows: its number, the content, the largest id, how many rows, and their ids.

    A stretch ends when contents and ids reach `limit` bytes, so a hot content leaves a task as a few folds of bounded size.
    """
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 40
    table, members, held = ContentTable(), [], 0

    def out() -> pa.RecordBatch:
        columns = [
            pa.array(range(number, number + len(members)), pa.int64()),
            pa.array([_signed(h) for h in table.hashes], pa.int64()),
            pa.array(table.contents, pa.binary()),
            pa.array([max(m) for m in members], pa.int64()),
            pa.array([len(m) for m in members], pa.int64()),
            pa.array([m.tolist() for m in members], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["fold", "h", "content", "top", "size", "members"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = text.as_py().translate(LOWER_AZ)
            entry = table.place(xxhash.xxh3_64_intdigest(content), content)
            if entry == len(members):
                members.append(array("q"))
            members[entry].append(doc_id)
            held += 8
            if table.bytes + held > limit:
                yield out()
                number += len(members)
                table, members, held = ContentTable(), [], 0
    if members:
        yield out()


#: A content with the folds that have it: hash, content, largest id, rows, numbers of the folds.
Record = tuple[int, bytes, int, int, array]


class _Groups:
    """Contents met so far, each once, with what its folds add up to."""

    def __init__(self) -> None:
        self.table, self.top, self.size, self.folds, self.held = ContentTable(), [], [], [], 0

    def add(self, record: Record) -> None:
        h, content, top, size, folds = record
        entry = self.table.place(h, content)
        if entry == len(self.top):
            self.top.append(top)
            self.size.append(0)
            self.folds.append(array("q"))
        self.top[entry] = max(self.top[entry], top)
        self.size[entry] += size
        self.folds[entry].extend(folds)
        self.held += 8 * len(folds)

    @property
    def bytes(self) -> int:
        return self.table.bytes + self.held

    def records(self) -> Iterator[Record]:
        return zip(self.table.hashes, self.table.contents, self.top, self.size, self.folds, strict=True)

    def resolved(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        folds, keep, size, sha = array("q"), [], [], []
        for _, content, top, n, mine in self.records():
            digest = hashlib.sha256(content).hexdigest()
            for at in range(0, len(mine), rows):
                part = mine[at : at + rows]
                folds.extend(part)
                keep += [top] * len(part)
                size += [n] * len(part)
                sha += [digest] * len(part)
                if len(folds) >= rows:
                    yield _rows(folds, keep, size, sha)
                    folds, keep, size, sha = array("q"), [], [], []
        if folds:
            yield _rows(folds, keep, size, sha)


RESOLVED = "fold long, keep_id long, group_size long, text_sha256 string"


def _rows(folds: array, keep: list[int], size: list[int], sha: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(folds.tolist(), pa.int64()), pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], ["fold", "keep_id", "group_size", "text_sha256"])


def _loaded(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _grace(records: Iterator[Record], level: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Resolves the records in one table if they fit; else deals them to spill files by the next hash bits, and each file likewise.

    Equal contents are one entry from the start, so a hot content takes its bytes once and eight for each fold, and is never
    dealt anew. The files belong to this task alone and go when it ends; a task that is run again makes its own.
    """
    groups = _Groups()
    for record in records:
        groups.add(record)
        if groups.bytes > limit and len(groups.top) > 1 and (level + 1) * LEVEL_BITS <= 60:
            break
    else:
        yield from groups.resolved()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        n = 1 << LEVEL_BITS
        files = [open(os.path.join(folder, str(k)), "wb") for k in range(n)]  # noqa: SIM115
        for record in chain(groups.records(), records):
            # the upper bits: the table probes by the lower ones
            pickle.dump(record, files[(record[0] >> (60 - level * LEVEL_BITS)) & (n - 1)], protocol=5)
        del groups
        for f in files:
            f.close()
        for f in files:
            yield from _grace(_loaded(f.name), level + 1, limit)
            os.unlink(f.name)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        for fold, h, content, top, size in zip(*(batch.column(k) for k in range(5)), strict=True):
            yield h.as_py() & (1 << 64) - 1, content.as_py(), top.as_py(), size.as_py(), array("q", [fold.as_py()])


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays.
    Each task first folds its own equal rows together and writes the folds. Contents then meet by hash, once a fold, and a partition beyond
    `table_bytes` is split over spill files by further hash bits, level by level. The ids of a fold stay with it and are joined by its
    number at last, so the rows of a text that a third of all have never meet in one task.

    A null text counts as empty. A doc_id that occurs in several rows counts each time; of equal rows with the largest id
    all are marked kept. A row without a doc_id is ignored. A text is held whole. Other columns are ignored. No rows give no rows.
    """
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(batches, table_bytes // 2)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grace(_records(batches), 0, table_bytes)

    folds = written(rows.mapInArrow(combine, "fold long, h long, content binary, top long, size long, members array<long>"))
    # h is a hash already; the spread over tasks takes all folds of a content to one
    resolved = folds.select("fold", "h", "content", "top", "size").repartition("h").mapInArrow(resolve, RESOLVED)
    each = folds.select("fold", "members").join(resolved, "fold").select(F.explode("members").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
