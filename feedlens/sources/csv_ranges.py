"""CSV files with quoted multi-line cells, read by byte ranges.

Spark's ``multiLine`` reader gives a whole file to one task. Here a file of any size is cut into
byte ranges, and a first pass counts the quotes of each range in parallel. A byte lies inside
quotes if the number of quotes before it is odd, so running sums of the counts over a file's
ranges (one row per range) tell each range whether it starts inside a cell. In the second pass a
task yields the records that *start* in its range: it skips the record that is open at its start,
and reads on beyond its end until its last record is closed. Nothing is shuffled but the counts.
Records come out as whole strings and Spark's own ``from_csv`` parses them.

Files follow RFC 4180: a cell that holds a quote, a separator or a line break is quoted, quotes
inside are doubled. A file whose quotes don't pair up is an error. Lines end with LF or CRLF; blank
lines are no records. Paths go through ``pyarrow.fs``. Compressed files are one range.

Defined cases: an empty file or folder has no records; a header is the first record of each file.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from feedlens.session import shared_dir

_CHUNK = 4 << 20
_QUOTE, _LF = 0x22, 0x0A
_PACKED = (".gz", ".bz2", ".zst", ".lz4")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the folder's data files at any depth."""
    from pyarrow import fs as pafs

    fs, root = _filesystem(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    plain = [i for i in found if i.type == pafs.FileType.File and not any(
        p.startswith(("_", ".")) for p in i.path[len(root):].split("/") if p)]
    return sorted((i.path, i.size) for i in plain)


def _open(fs, path: str):
    """(stream that can seek, bytes), compressed files unpacked."""
    if not path.endswith(_PACKED):
        stream = fs.open_input_file(path)
        return stream, stream.size()
    with fs.open_input_stream(path, compression="detect") as f:
        data = f.read()
    return pa.BufferReader(data), len(data)


def count_quotes(stream, start: int, end: int) -> int:
    stream.seek(start)
    total = 0
    while start < end:
        part = stream.read(min(_CHUNK, end - start))
        if not part:
            break
        total += part.count(b'"')
        start += len(part)
    return total


def range_records(stream, size: int, start: int, end: int, inside: bool):
    """Arrays of the records that start in bytes [start, end); ``inside``: the byte at ``start``
    lies in a quoted cell. Line ends are cut off, blank lines left out."""
    end = min(end, size)
    if start >= end:
        return
    first = start == 0  # whether a record starts here: if the byte before ends a line
    if start:
        stream.seek(start - 1)
        first = stream.read(1) == b"\n" and not inside
    stream.seek(start)
    at, held = start, b""  # bytes since the last record's end
    while at < size:
        part = stream.read(_CHUNK)
        if not part:
            break
        data = np.frombuffer(part, np.uint8)
        odd = (np.cumsum(data == _QUOTE) + int(inside)) % 2 == 1  # after each byte; a line feed changes nothing
        breaks = np.flatnonzero((data == _LF) & ~odd) + 1  # where the next record starts
        inside = bool(odd[-1])
        own = breaks[breaks + at < end]  # starts of records of this range
        if first:
            starts = np.concatenate([[0], own + len(held)])
        elif len(own):
            starts, first = own + len(held), True
        else:
            starts = None
        if starts is not None:
            both = held + part
            past = breaks[breaks + at >= end]
            if len(past):  # the last record is closed
                yield _strings(both[:len(held) + int(past[0])], np.append(starts, len(held) + int(past[0])))
                return
            if len(starts) > 1:
                yield _strings(both[:int(starts[-1])], starts)
            held = both[int(starts[-1]):]
        at += len(part)
        if starts is None and at >= end:
            return  # one cell covers the range
    if inside:
        raise ValueError("a quoted cell has no end: the file's quotes don't pair up")
    if first and held:
        yield _strings(held, np.array([0, len(held)]))


def _strings(data: bytes, cuts: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data)]
    out = pc.utf8_rtrim(pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, buffers), "\r\n")
    return out.filter(pc.not_equal(out, "")).cast(pa.string())


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool):
        super().__init__(None)
        self.path, self.start, self.end, self.inside = path, start, end, inside


class _Source(DataSource):
    """Options: path; range_bytes; ranges (a file written by ``read_csv_ranges``)."""


class QuoteCounts(_Source):
    @classmethod
    def name(cls) -> str:
        return "csv_quote_counts"

    def schema(self) -> str:
        return "path string, start long, until long, quotes long"

    def reader(self, schema) -> DataSourceReader:
        return CountReader(dict(self.options))


class CountReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options["range_bytes"])

    def partitions(self):
        out = []
        for path, size in list_files(self.path):
            step = size if path.endswith(_PACKED) else self.step
            out += [Range(path, s, min(s + step, size), False) for s in range(0, size, max(step, 1))]
        return out or [Range("", 0, 0, False)]

    def read(self, part: Range):
        if part.path:
            fs, _ = _filesystem(self.path)
            stream, size = _open(fs, part.path)
            end = size if part.path.endswith(_PACKED) else part.end
            yield part.path, part.start, end, count_quotes(stream, part.start, end)


class Records(_Source):
    @classmethod
    def name(cls) -> str:
        return "csv_records"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ranges, self.header = options["path"], options["ranges"], options["header"] == "true"

    def partitions(self):
        fs, path = _filesystem(self.ranges)
        with fs.open_input_stream(path, compression=None) as f:
            told = json.loads(f.read())
        return [Range(p, s, e, i) for p, s, e, i in told] or [Range("", 0, 0, False)]

    def read(self, part: Range):
        if not part.path:
            return
        fs, _ = _filesystem(self.path)
        stream, size = _open(fs, part.path)
        skip = int(self.header and part.start == 0)
        for records in range_records(stream, size, part.start, part.end, part.inside):
            records, skip = records[skip:], skip - min(skip, len(records))
            for at in range(0, len(records), 4096):
                yield pa.RecordBatch.from_arrays([records[at:at + 4096]], names=["record"])


def csv_records(spark: SparkSession, path: str, *, header: bool = True, range_bytes: int = 32 << 20) -> DataFrame:
    """``record``: every record of the file or folder as one string, read by byte ranges."""
    for source in (QuoteCounts, Records):
        spark.dataSource.register(source)
    counts = spark.read.format("csv_quote_counts").option("path", path).option("range_bytes", range_bytes).load()
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    rows = counts.withColumn("inside", inside).orderBy("path", "start").collect()  # a row per range, as in a file listing
    for r, following in zip(rows, [*rows[1:], None]):
        if (following is None or following.path != r.path) and (r.inside + r.quotes) % 2:
            raise ValueError(f"{r.path}: a quoted cell has no end: the file's quotes don't pair up")
    ranges = f"{shared_dir(spark, 'csv-ranges')}/{uuid.uuid4().hex}.json"
    fs, target = _filesystem(ranges)
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(target, compression=None) as out:
        out.write(json.dumps([[r.path, r.start, r.until, bool(r.inside)] for r in rows]).encode())
    return (spark.read.format("csv_records").option("path", path).option("ranges", ranges)
            .option("header", str(header).lower()).load())
