"""Arrow hand-off: tables as Arrow IPC stream files, for readers without Spark.

``format("arrow_files")`` writes every task's record batches to files of its own, named by a random
id, and lists them in a manifest when the whole write commits. Readers take only files that a
manifest names, so files of lost or repeated task attempts, and of writes that failed, are never
seen. Files are read batch by batch, one input partition per run of files of at most
``partition_bytes``. Paths go through ``pyarrow.fs``.

Defined cases: an empty table writes a manifest without files and is read back as no rows, with
the schema the reader names. A folder without a manifest has no rows. Appending adds a manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, int, int], ...]  # name, bytes, rows


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class ArrowFiles(DataSource):
    """Options: path; file_bytes (rolls a task's files); partition_bytes (files per input partition)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def reader(self, schema) -> DataSourceReader:
        return ArrowFilesReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowFilesWriter(dict(self.options))


class ArrowFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll = options["path"].rstrip("/"), int(options.get("file_bytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, sink, name, rows = [], None, None, "", 0

        def close():
            nonlocal out
            out.close()
            files.append((name, sink.tell(), rows))
            sink.close()
            out = None

        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                name, rows = f"{uuid.uuid4().hex}.arrows", 0
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                out = pa.ipc.new_stream(sink, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
            if sink.tell() >= self.roll:
                close()
        if out is not None:
            close()
        return Written(tuple(files))

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        listed = [f for m in messages if m for f in m.files]
        made = f"{root}/.{uuid.uuid4().hex}"  # complete before it has a name that readers look for
        with fs.open_output_stream(made, compression=None) as out:
            out.write(json.dumps(listed).encode())
        fs.move(made, f"{root}/manifest-{uuid.uuid4().hex}.json")

    def abort(self, messages) -> None:
        fs, root = _filesystem(self.path)
        for name, _, _ in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{root}/{name}")


def listed_files(path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, rows) of the files that committed writes left."""
    from pyarrow import fs as pafs

    fs, root = _filesystem(path.rstrip("/"))
    out = []
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("manifest-"):
            with fs.open_input_stream(info.path, compression=None) as f:
                out += [tuple(x) for x in json.loads(f.read())]
    return sorted(out)


def read_batches(path: str, columns: list[str] | None = None, names: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of the committed files (or of those named), one at a time, without Spark."""
    fs, root = _filesystem(path.rstrip("/"))
    for name in names if names is not None else [n for n, _, _ in listed_files(path)]:
        with fs.open_input_stream(f"{root}/{name}", compression=None) as f, pa.ipc.open_stream(f) as batches:
            for batch in batches:
                yield batch if columns is None else batch.select(columns)


class ArrowFilesReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.most = int(options.get("partition_bytes", 64 << 20))

    def partitions(self):
        parts, held, size = [], [], 0
        for name, n, _ in listed_files(self.path):
            if held and size + n > self.most:
                parts.append(Files(tuple(held)))
                held, size = [], 0
            held.append(name)
            size += n
        return [*parts, Files(tuple(held))]

    def read(self, partition: Files):
        yield from read_batches(self.path, self.columns, partition.paths)


def write_arrow(df: DataFrame, path: str, **options) -> None:
    spark = df.sparkSession
    spark.dataSource.register(ArrowFiles)
    df.write.format("arrow_files").mode("append").options(**options).save(path)


def read_arrow(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """The committed rows; of each file only the columns of ``schema``."""
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").schema(schema).options(**options).load(path)
