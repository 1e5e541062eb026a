"""Files of ``(row, family, qualifier, value)`` cells as a Spark data source, ``format("cells")``.

One cell a line, fields parted by tabs, backslash escapes inside, ``\\N`` for NULL.  Large
files are read in byte ranges.  A write goes to a folder of its own first; files move to the
target only when all tasks have ended well, so a failed job leaves nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The classes of this module travel with the query; executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "row string, family string, qualifier string, value string"
FIELDS = ["row", "family", "qualifier", "value"]
RANGE_BYTES = 64 << 20
BATCH_ROWS = 10_000
_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
_TABLE = str.maketrans(_ESCAPES)
_BACK = {escaped[1]: plain for plain, escaped in _ESCAPES.items()}


def _encode(field: str | None) -> str:
    return "\\N" if field is None else field.translate(_TABLE)


def _decode(field: str) -> str | None:
    if "\\" not in field:
        return field
    if field == "\\N":
        return None
    first, *rest = field.split("\\")
    out, i = [first], 0
    while i < len(rest):
        if rest[i]:
            out.append(_BACK[rest[i][0]] + rest[i][1:])
        else:  # an escaped backslash leaves an empty part before the text behind it
            out.append("\\" + (rest[i + 1] if i + 1 < len(rest) else ""))
            i += 1
        i += 1
    return "".join(out)


@dataclass
class CellRange(InputPartition):
    """The lines that start in ``[start, end)`` of a file."""

    file: str
    start: int
    end: int


class CellReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[CellRange]:
        store, root = fs.FileSystem.from_uri(self.path)
        files = store.get_file_info(fs.FileSelector(root))
        shown = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name[0] not in "_.")
        return [CellRange(path, at, min(at + self.range_bytes, size)) for path, size in shown for at in range(0, size, self.range_bytes)]

    def read(self, partition: CellRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        lines: list[list[str | None]] = []
        schema = pa.schema([(name, pa.string()) for name in FIELDS])
        with store.open_input_file(partition.file) as file:
            at = max(partition.start - 1, 0)
            file.seek(at)
            buffered = _Lines(file, at)
            if partition.start:
                buffered.next()  # the rest of a line that starts before
            while buffered.at < partition.end and (line := buffered.next()):
                lines.append([_decode(f) for f in line[:-1].decode("utf-8").split("\t")])
                if len(lines) == BATCH_ROWS:
                    yield _batch(lines, schema)
                    lines = []
        if lines:
            yield _batch(lines, schema)


class _Lines:
    """Lines of an open file from a place on, read in blocks; ``at`` is where the next one starts."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.block, self.used = file, at, b"", 0

    def next(self) -> bytes:
        parts = []
        while True:
            end = self.block.find(b"\n", self.used)
            if end >= 0:
                parts.append(self.block[self.used:end + 1])
                self.used = end + 1
                break
            parts.append(self.block[self.used:])
            self.block, self.used = self.file.read(1 << 20), 0
            if not self.block:
                break
        line = b"".join(parts)
        self.at += len(line)
        return line


def _batch(lines: list[list[str | None]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*lines)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    file: str
    cells: int


class CellWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staging = self._places()
        store.create_dir(staging, recursive=True)
        # Every attempt of a task has a file of its own.
        name, cells = f"part-{TaskContext.get().partitionId():05d}-{uuid4().hex}", 0
        with store.open_output_stream(f"{staging}/{name}") as out:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(f)).cast(pa.string()).to_pylist() for f in FIELDS]
                out.write("".join("\t".join(map(_encode, cell)) + "\n" for cell in zip(*columns)).encode("utf-8"))
                cells += batch.num_rows
        return Written(name, cells)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, staging = self._places()
        store.create_dir(root, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File] if self.overwrite else []
        for message in messages:
            if message is not None and message.cells:
                store.move(f"{staging}/{message.file}", f"{root}/{message.file}")
        for path in old:
            store.delete_file(path)
        self._clear(store, staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, staging = self._places()
        self._clear(store, staging)

    @staticmethod
    def _clear(store: fs.FileSystem, staging: str) -> None:
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class CellSource(DataSource):
    """``spark.read.format("cells").load(path)``; option ``rangeBytes`` sets how large files are cut."""

    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CellReader:
        return CellReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> CellWriter:
        missing = set(FIELDS) - set(schema.names)
        if missing:
            raise ValueError(f"cells need the columns {sorted(missing)}")
        return CellWriter(self.options["path"], overwrite)


def write_cells(cells: DataFrame, path: str, overwrite: bool = False) -> str:
    """Write a frame of cells; all its files appear, or none.  ``path`` is absolute or a URI."""
    cells.sparkSession.dataSource.register(CellSource)
    cells.select(*FIELDS).write.format("cells").mode("overwrite" if overwrite else "append").save(path)
    return path


def read_cells(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(CellSource)
    return spark.read.format("cells").option("rangeBytes", range_bytes).load(path)
