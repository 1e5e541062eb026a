"""One text file per name as a Spark data source, ``format("textfiles")``, for writing.

Each task writes its files to a folder of its own, which moves to the target as a whole when
all tasks have ended well: a failed job leaves nothing, and the driver moves a folder per
task instead of a file per row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# The classes of this module travel with the query; executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Folder(WriterCommitMessage):
    name: str
    files: int


class TextFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.job = path, suffix, uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        store, _, staging = self._places()
        # Every attempt of a task has a folder of its own.
        folder, files, last, out = f"part-{TaskContext.get().partitionId():05d}-{uuid4().hex}", 0, None, None
        store.create_dir(f"{staging}/{folder}", recursive=True)
        try:
            for batch in iterator:
                names, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "value"))
                for name, text in zip(names.to_pylist(), texts):
                    if not name:
                        raise ValueError("a file needs a name")
                    if name != last:
                        if out is not None:
                            out.close()
                        out = store.open_output_stream(f"{staging}/{folder}/{quote(name, safe='')}{self.suffix}")
                        last, files = name, files + 1
                    if text.is_valid:
                        out.write(text.as_buffer())
                    out.write(b"\n")
        finally:
            if out is not None:
                out.close()
        return Folder(folder, files)

    def commit(self, messages: list[Folder | None]) -> None:
        store, root, staging = self._places()
        store.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.files:
                store.move(f"{staging}/{message.name}", f"{root}/{message.name}")
        self._clear(store, staging)

    def abort(self, messages: list[Folder | None]) -> None:
        store, _, staging = self._places()
        self._clear(store, staging)

    @staticmethod
    def _clear(store: fs.FileSystem, staging: str) -> None:
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], self.options.get("suffix", ""))


def write_text_files(df: DataFrame, name: Column, text: Column, path: str, suffix: str = "") -> str:
    """A file ``<name><suffix>`` per name, in one folder per task below ``path``; each text ends with a line feed, NULL is empty.

    Names are percent-encoded.  Rows of the same name in a task share a file, one after the other.
    """
    df.sparkSession.dataSource.register(TextFiles)
    rows = df.select(name.cast("string").alias("name"), text.cast("string").alias("value")).sortWithinPartitions("name")
    rows.write.format("textfiles").option("suffix", suffix).mode("append").save(path)
    return path
