"""Segment files as a data source of Spark: a scan reads headers alone, and a write shows all its files or none."""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format: magic, version, bytes of the header.
MAGIC, VERSION, HEADER = b"BSEG", 1, 21
SUFFIX, LEFTOVER, STAGE = ".bseg", ".tmp", ".stage-"
#: Files that one task lists and reads the headers of.
SHARE = 4096
#: Files that a commit moves at once, and one of its threads.
MOVED, EACH = 8192, 256

SCAN = "path string, size long, modified_ms long, start_ms long, sample_rate int, num_samples int, duration_ms long, end_ms long, status string"
FILES = "name string, blob binary"


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder, its path there, and what stands before such a path in a URI."""
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    store, base = fs.FileSystem.from_uri(uri)
    return store, base.rstrip("/"), uri[: uri.index("://") + 3] + uri.split("://")[1].split("/")[0] if "://" in path and not path.startswith("file:") else ""


@lru_cache(maxsize=64)
def _folder_store(folder: str) -> tuple[fs.FileSystem, str]:
    return store_of(folder)[:2]


def file_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file and its path there; neighbours share the look-up of their folder."""
    folder, name = path.rsplit("/", 1)
    store, base = _folder_store(folder)
    return store, f"{base}/{name}"


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds; a local one is gone through without holding its list."""
    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                yield from ((e.name, e.is_dir()) for e in found)
        except FileNotFoundError:
            return
    else:
        yield from ((i.base_name, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _is_segment(name: str) -> bool:
    return name.endswith((SUFFIX, SUFFIX + LEFTOVER))


def parsed(head: bytes) -> tuple[int | None, int | None, int | None, int | None, int | None, str]:
    """(start_ms, sample_rate, num_samples, duration_ms, end_ms, status) of the first bytes of a file; status is ok, short, bad_magic or bad_version."""
    status = "short" if len(head) < HEADER else "bad_magic" if head[:4] != MAGIC else "bad_version" if head[4] != VERSION else "ok"
    if status != "ok":
        return None, None, None, None, None, status
    rate, start, n = struct.unpack(">iqi", head[5:HEADER])
    duration = n * 1000 // rate if rate > 0 else None
    return start, rate, n, duration, None if duration is None else start + duration, status


@dataclass
class FileRange(InputPartition):
    """Files of folders: of a large one those from the first name to the last, both included; of small ones all."""

    folders: list[str]
    first: str = ""
    last: str | None = None


class SegmentReader(DataSourceReader):
    """The driver keeps two names for each `SHARE` files of a folder, and the names of folders with fewer, which share tasks; tasks list their folders and read HEADER bytes of each file."""

    def __init__(self, path: str, share: int) -> None:
        self.path, self.share = path, share

    def partitions(self) -> list[FileRange]:
        store, base, _ = store_of(self.path)
        ranges, folders = [], [base]
        few: list[str] = []
        held = 0
        while folders:
            folder = folders.pop()
            names = []
            for name, below in _entries(store, folder):
                if below:
                    if not name.startswith((".", "_")):
                        folders.append(f"{folder}/{name}")
                elif _is_segment(name):
                    names.append(name)
            if len(names) >= self.share:
                names.sort()
                ranges += [FileRange([folder], names[k], names[min(k + self.share, len(names)) - 1]) for k in range(0, len(names), self.share)]
            elif names:
                if held + len(names) > self.share:
                    ranges.append(FileRange(few))
                    few, held = [], 0
                few.append(folder)
                held += len(names)
        return [*ranges, FileRange(few)] if few or not ranges else ranges

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        store, _, before = store_of(self.path)
        rows = []
        for folder in partition.folders:
            within = (n for n, below in _entries(store, folder) if not below and _is_segment(n) and partition.first <= n and (partition.last is None or n <= partition.last))
            for name in sorted(within):
                info = store.get_file_info(f"{folder}/{name}")
                if info.type != fs.FileType.File:  # it went between the listing and now
                    continue
                known = (f"{before}{info.path}", info.size, int(info.mtime_ns // 1_000_000))
                if name.endswith(LEFTOVER):
                    rows.append((*known, None, None, None, None, None, "leftover"))
                    continue
                try:
                    with store.open_input_file(info.path) as file:
                        rows.append((*known, *parsed(file.read_at(min(HEADER, info.size), 0))))
                except FileNotFoundError:
                    continue
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCAN.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """The files of one attempt, numbered in its folder of the stage, and their names, packed: the driver unpacks those of one attempt at a time."""

    attempt: str
    packed: bytes

    def names(self) -> list[str]:
        text = zlib.decompress(self.packed).decode()
        return text.split("\0") if text else []


def _digest(name: str) -> bytes:
    return hashlib.blake2b(name.encode(), digest_size=8).digest()


def _given_twice(written: list[Written]) -> bool:
    """Whether a name is there twice: eight bytes a name tell which to look at."""
    digests = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b"".join(map(_digest, m.names())), np.int64) for m in written)])
    same, counts = np.unique(digests, return_counts=True)
    doubtful = {d.tobytes() for d in same[counts > 1]}
    names = [n for m in written for n in m.names() if _digest(n) in doubtful] if doubtful else []
    return len(set(names)) < len(names)


class SegmentWriter(DataSourceArrowWriter):
    """Attempts write below a hidden folder of the job, each in a folder of its own; the commit moves the files of the attempts that count.

    A task that fails removes its folder, and whatever an attempt that was killed or came second has left goes with the job's folder, at the commit or
    the abort. A name that is there already is replaced. Names are paths below the folder; a name that leaves it is refused, as is one given twice.
    """

    def __init__(self, path: str) -> None:
        self.path, self.stage = path, f"{STAGE}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base, _ = store_of(self.path)
        attempt, names = uuid.uuid4().hex, []
        own = f"{base}/{self.stage}/{attempt}"
        try:
            for batch in iterator:
                for name, blob in zip(batch.column("name").to_pylist(), batch.column("blob"), strict=True):
                    if not name or not blob.is_valid or name.startswith("/") or ".." in name.split("/") or "\0" in name:
                        raise ValueError(f"not a file below the folder: {name!r}")
                    if not names:
                        store.create_dir(own, recursive=True)
                    names.append(name)
                    with store.open_output_stream(f"{own}/{len(names) - 1}") as out:
                        out.write(blob.as_buffer())
        except BaseException:
            if names:
                store.delete_dir(own)
            raise
        return Written(attempt, zlib.compress("\0".join(names).encode(), 1))

    def commit(self, messages: list[Written | None]) -> None:
        store, base, _ = store_of(self.path)
        written = [m for m in messages if m is not None]
        if _given_twice(written):
            self.abort(messages)
            raise ValueError("a name is given twice")

        def move(part: tuple[tuple[str, str], ...]) -> None:
            for staged, name in part:
                store.move(f"{base}/{self.stage}/{staged}", f"{base}/{name}")

        with ThreadPoolExecutor(16) as pool:
            moves = ((f"{m.attempt}/{k}", name) for m in written for k, name in enumerate(m.names()))
            for some in batched(moves, MOVED):
                for folder in {f"{base}/{name}".rsplit("/", 1)[0] for _, name in some}:
                    store.create_dir(folder, recursive=True)
                list(pool.map(move, batched(some, EACH)))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base, _ = store_of(self.path)
        for wait in (0.05, 0.2, 1.0, None):
            if store.get_file_info(f"{base}/{self.stage}").type != fs.FileType.Directory:
                return
            try:
                return store.delete_dir(f"{base}/{self.stage}")
            except OSError:  # tasks that were told to end write or remove files at the same time
                if wait is None:
                    raise
                time.sleep(wait)


class SegmentSource(DataSource):
    """spark.read.format("segments").load(folder), with the option share; files (name, blob) are written by mode append."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options["path"], int(self.options.get("share", SHARE)))

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        if overwrite:
            raise ValueError("segments are appended")
        return SegmentWriter(self.options["path"])
