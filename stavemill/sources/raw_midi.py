"""Raw keyboard bytes as a Spark data source, in batch and as a stream.

A file is a row of records of 15 bytes: the time in milliseconds (8 bytes) and the session (4), both big-endian,
then the three bytes of the message. Files are cut into ranges of whole records, one task each. As a stream the
offset is the length of whole records seen of each file, so files may grow, and a last record that is not yet whole
waits for the next batch.

    spark.dataSource.register(RawMidi)
    spark.read.format("raw_midi").load(path)            # or readStream
    messages.write.format("raw_midi").mode("append").save(path)

Options: ``path`` (any file system pyarrow knows), ``rangeBytes``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)

RECORD = np.dtype([("t_ms", ">i8"), ("session_id", ">i4"), ("status", "u1"), ("d1", "u1"), ("d2", "u1")])
#: Columns of a message; ``file`` and ``at`` (its byte) say where it was read.
COLUMNS = "session_id bigint, t_ms bigint, status int, d1 int, d2 int"
SCHEMA = COLUMNS + ", file string, at bigint"
RANGE_BYTES = 32 << 20
BATCH = 65_536


@dataclass
class Range(InputPartition):
    """Whole records of a file from byte ``start`` up to ``end``."""
    file: str
    start: int
    end: int


def whole(size: int) -> int:
    return size - size % RECORD.itemsize


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Length in whole records of every file of the folder."""
    system, root = located(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: whole(f.size) for f in found if f.type == fs.FileType.File
            and not any(part.startswith(("_", ".")) for part in f.path[len(root):].split("/"))}


def ranges(before: dict[str, int], after: dict[str, int], limit: int) -> list[Range]:
    """What lies between two states of a folder, cut into ranges of about ``limit`` bytes."""
    step = max(whole(limit), RECORD.itemsize)
    return [Range(f, at, min(at + step, end)) for f, end in sorted(after.items())
            for at in range(before.get(f, 0), end, step)]


def read_range(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    if part.start >= part.end:
        return
    with located(path)[0].open_input_file(part.file) as f:
        for at in range(part.start, part.end, BATCH * RECORD.itemsize):
            data = f.read_at(min(BATCH * RECORD.itemsize, part.end - at), at)
            records = np.frombuffer(data, RECORD, count=whole(len(data)) // RECORD.itemsize)
            n = len(records)
            yield pa.RecordBatch.from_arrays(
                [pa.array(records["session_id"].astype("i8")), pa.array(records["t_ms"].astype("i8")),
                 *[pa.array(records[c].astype("i4")) for c in ("status", "d1", "d2")],
                 pa.array([part.file] * n, pa.string()), pa.array(at + np.arange(n) * RECORD.itemsize)],
                names=["session_id", "t_ms", "status", "d1", "d2", "file", "at"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def partitions(self) -> list[Range]:
        # One empty range stands for no files at all.
        return ranges({}, sizes(self.path), self.limit) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.limit)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Every task writes a hidden file; the commit of the job shows them."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = located(self.path)
        name, n = f"{uuid.uuid4().hex}.raw", 0
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_{name}") as out:
            for batch in iterator:
                records = np.empty(batch.num_rows, RECORD)
                for c in RECORD.names:
                    records[c] = batch.column(c).to_numpy(zero_copy_only=False)
                out.write(records.tobytes())
                n += batch.num_rows
        return _Written([name] if n else [])

    def commit(self, messages: list) -> None:
        system, root = located(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list) -> None:
        system, root = located(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{root}/_{name}")


class RawMidi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_midi"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, int]:
        return self.options["path"].rstrip("/"), int(self.options.get("rangebytes", RANGE_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._args())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._args())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("raw files are appended to, never replaced")
        return _Writer(self._args()[0])
