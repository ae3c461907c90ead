"""Chunk files as a Spark data source: format("chunk_files").

Reading: a task takes the leading items of each of its files, some hundred bytes, and reads the arrays only where those
pass the filters that Spark pushed down (``spark.sql.python.filterPushdown.enabled``) or the options `beams` and `fpga`.

Writing, in two phases: tasks put files and links below a temporary folder; only if all have succeeded does the driver
move them to their names. A job that fails, or a task that is run twice, leaves nothing under a file's own name; the
temporary folder is deleted, but tasks that run on while a job is given up may still write to it, and readers pass it by.
"""

from __future__ import annotations

import dataclasses
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .chunk_files import ARROW, CHUNK, COLUMNS, HEAD_BYTES, leading_items, unpack_chunk
from .shared import opened

#: Files of a task take about so many bytes together, or are so many.
TASK_BYTES, TASK_FILES = 64 << 20, 2000
BATCH_BYTES = 8 << 20

TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}
HEADER = {name for name, kind in COLUMNS if kind in ("int", "long")} - {"frame0_nano", "nrfifreq"}


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def fetched(file: pa.NativeFile, size: int, at: int) -> bytes:
    return file.read_at(size, at)


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.tests: list[tuple] = []  # (column, test, value)
        if beams := options.get("beams"):
            self.tests.append(("beam_id", TESTS[In], frozenset(int(b) for b in beams.split(","))))
        if span := options.get("fpga"):  # counts from the first on, before the second
            self.begin, self.end = map(int, span.split(","))
        else:
            self.begin = self.end = None

    def partitions(self) -> list[_Files]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        own = [f for f in found if f.is_file and ".msg" in f.base_name and not any(p[:1] in ("_", ".") for p in f.path[len(root) :].split("/") if p)]
        tasks, size = [[]], 0
        for f in sorted(own, key=lambda f: f.path):
            if tasks[-1] and (size + f.size > TASK_BYTES or len(tasks[-1]) >= TASK_FILES):
                tasks.append([])
                size = 0
            tasks[-1].append(f.path)
            size += f.size
        return [_Files(paths) for paths in tasks]

    def wanted(self, head: dict) -> bool:
        inside = self.begin is None or (head["fpga_begin"] < self.end and head["fpga_begin"] + head["fpga_n"] > self.begin)
        return inside and all(test(head[name], value) for name, test, value in self.tests)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        chunks, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as f:
                total = f.size()
                data = fetched(f, min(HEAD_BYTES, total), 0)
                if not self.wanted(leading_items(data)):
                    continue
                data += fetched(f, total - len(data), len(data)) if total > len(data) else b""
            chunks.append(unpack_chunk(data))
            size += total
            if size > BATCH_BYTES:
                yield batch_of(chunks)
                chunks, size = [], 0
        yield batch_of(chunks)


class FilteringReader(ChunkReader):
    """A reader that takes filters, which Spark allows only where it pushes them into sources of Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADER
            if known:
                self.tests.append((f.attribute[0], TESTS[type(f)], f.value))
            else:
                yield f


def batch_of(chunks: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c[name] for c in chunks], ARROW[kind]) for name, kind in COLUMNS], names=[name for name, _ in COLUMNS])


@dataclasses.dataclass
class Staged(WriterCommitMessage):
    """A task's folder, as a path on its file system."""

    folder: str


def same_bytes(files: fs.FileSystem, path: str, data: bytes) -> bool:
    with files.open_input_stream(path) as f:
        return f.read() == data


class ChunkWriter(DataSourceArrowWriter):
    """Rows (filename, payload, ...) become files, rows (filename, source, ...) links to other files below the path, or copies
    where the file system has no links. Statuses, with the rows' other columns, are a table below the path."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("chunk files are never overwritten")
        self.path, self.job = options["path"], options.get("job") or uuid.uuid4().hex

    def _folders(self) -> tuple[fs.FileSystem, str, str, str]:
        files, root = opened(self.path)
        root = root.rstrip("/")
        return files, root, f"{root}/_temporary-{self.job}", f"{root}/_status-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root, temporary, _ = self._folders()
        own, parts = f"{temporary}/{uuid.uuid4().hex}", []
        files.create_dir(f"{own}/status", recursive=True)
        for batch in iterator:
            what = "payload" if "payload" in batch.schema.names else "source"
            done = [self._staged(files, root, own, name.lstrip("/"), value, what) for name, value in zip(batch.column("filename").to_pylist(), batch.column(what).to_pylist())]
            kept = [c for c in batch.schema.names if c != what]
            status = pa.array(["SUCCEEDED" if n is not None else "FAILED" for n in done], pa.string())
            parts.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), status, pa.array([n or 0 for n in done], pa.int64())], names=[*kept, "status", "nbytes"]))
        if parts:
            pa.parquet.write_table(pa.Table.from_batches(parts), f"{own}/status/{uuid.uuid4().hex}.parquet", filesystem=files)
        return Staged(own)

    def _staged(self, files: fs.FileSystem, root: str, own: str, name: str, value, what: str) -> int | None:
        """The file's size, or nothing where its name has been taken by other bytes."""
        target, staged = f"{root}/{name}", f"{own}/files/{name}"
        source = None if what == "payload" else f"{root}/{value.lstrip('/')}"
        if source is not None:
            with files.open_input_stream(source) as f:
                value = f.read()
        for there in (target, staged):
            if files.get_file_info(there).type != fs.FileType.NotFound:
                return len(value) if same_bytes(files, there, value) else None
        files.create_dir(staged.rpartition("/")[0], recursive=True)
        if source is not None and isinstance(files, fs.LocalFileSystem):
            os.link(source, staged)
        else:
            with files.open_output_stream(staged) as f:
                f.write(value)
        return len(value)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root, temporary, statuses = self._folders()
        files.create_dir(statuses, recursive=True)
        for folder in (m.folder for m in messages if m is not None):
            self._moved(files, f"{folder}/files", root)
            self._moved(files, f"{folder}/status", statuses)
        self._removed(files, temporary)

    def _moved(self, files: fs.FileSystem, folder: str, root: str) -> None:
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            return
        for f in files.get_file_info(fs.FileSelector(folder, recursive=True)):
            if f.is_file:
                target = f"{root}/{f.path[len(folder) :].lstrip('/')}"
                if files.get_file_info(target).type != fs.FileType.NotFound:
                    with files.open_input_stream(f.path) as staged:
                        if not same_bytes(files, target, staged.read()):
                            raise ValueError(f"{target} is wanted with different bytes")
                    continue
                files.create_dir(target.rpartition("/")[0], recursive=True)
                files.move(f.path, target)

    def _removed(self, files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)

    def abort(self, messages: list[Staged | None]) -> None:
        files, _, temporary, _ = self._folders()
        self._removed(files, temporary)


class ChunkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema: StructType) -> ChunkReader:
        return (FilteringReader if self.options.get("push") == "true" else ChunkReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options, overwrite)
