"""WARC archives: a Python data source that writes and reads them, and page archiving.

``format("warc")`` plans one input partition per run of files of at most ``partition_bytes``
(a larger file is a partition of its own), from the manifests that committed writes left.
Filters on record_type, target_uri, record_id and the other header columns are pushed into the
reader: it inflates a record's header block first, tests the header predicates, and skips the
payload of every record that fails them, or of all records when the schema asks for no column
made from payloads. Every record is a gzip member of its own that carries its compressed length
in a header field, so a skipped payload is not even inflated. Archives by other writers lack the
field: their members are inflated in order, with any number of records in a member, and skipped
payloads are not kept. A file that doesn't start as gzip is read as plain records. In records of
type application/http the payload starts behind the HTTP head, which is read for its length; the
body is given as it was sent (chunked or compressed bodies stay so).

Writers put records into files of their own, named by a random id, and report them in their
commit message; only files named in the manifest of a committed write are read, so files of lost
or repeated task attempts don't count. Paths go through ``pyarrow.fs``.

Defined cases: a null payload is empty. Null page ids are written without the header and read
back as null. A file that ends inside a record is an error. Of records with equal payloads of at least ``least_bytes`` bytes, exactly one is
the response, that with the largest page id (a null id is the smallest; among rows that repeat
the id, one of them). An empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In,
                                    InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage)

from feedlens.session import shared_dir
from feedlens.sources.files import materialize

SCHEMA = ("record_type string, record_id string, target_uri string, page_id long, payload_bytes long, "
          "payload_digest string, refers_to long, payload binary")
# columns that come from headers alone, and so can be tested before a payload is touched
HEADERS = ("record_type", "record_id", "target_uri", "page_id", "refers_to")
_READ = 1 << 16


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- records -------------------------------------------------------------------------------

def member(data: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds its compressed length."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HQ", 8, total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, uri: str | None, page_id: int | None, payload: bytes, digest: str, size: int,
           refers_to: int | None) -> bytes:
    """A WARC 1.1 record; a revisit has no payload but keeps the full payload's digest and length."""
    number = f"{kind}/{page_id}/{uri}/{digest}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, number)}>",
             "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {size}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri.replace("%", "%25")))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def header_columns(block: bytes) -> dict:
    """The header columns of one record's header block, with its content length."""
    named = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        named[name.strip().lower()] = value.strip()
    digest = named.get("warc-payload-digest", "")
    number = lambda name: int(named[name]) if name in named else None
    uri, length = named.get("warc-target-uri"), number("content-length") or 0
    if uri is not None and "x-payload-length" in named:  # this writer's escapes
        from urllib.parse import unquote

        uri = unquote(uri)
    http = named.get("content-type", "").lower().startswith("application/http")
    return {"http": http, "record_type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "target_uri": uri,
            "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "length": length,
            "payload_bytes": number("x-payload-length") if "x-payload-length" in named else length,
            "payload_digest": base64.b32decode(digest[5:]).hex() if digest[:5].lower() == "sha1:" else None}


def passes(tests: list, columns: dict) -> bool:
    """Header predicates as (kind, column, value)."""
    for kind, name, value in tests:
        got = columns[name]
        if kind == "null safe":
            if got != value:
                return False
        elif got is None or kind == "equal" and got != value or kind == "in" and got not in value or kind == "starts" and not got.startswith(value):
            return False
    return True


def _inflated(stream, at: int):
    """The bytes of the gzip members from ``at`` on, in bounded pieces."""
    stream.seek(at)
    inflate, raw, inside = zlib.decompressobj(31), b"", False
    while raw or (raw := stream.read(_READ)):
        if not inside and not (raw := raw.lstrip(b"\0")):  # padding between members
            continue
        piece, inside = inflate.decompress(raw, 1 << 20), True
        raw = inflate.unconsumed_tail
        if inflate.eof:
            inflate, raw, inside = zlib.decompressobj(31), inflate.unused_data, False
        if piece:
            yield piece
    if inside:
        raise ValueError("a gzip member has no end")


class _Feed:
    """Bytes to come: from a generator of pieces, or of a plain file, which can also be skipped."""

    def __init__(self, pieces=None, plain=None):
        self.held, self.plain = bytearray(), plain
        self.pieces = pieces or iter(lambda: plain.read(_READ), b"")

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def upto(self, mark: bytes, most: int | None = None) -> int:
        """Place of ``mark`` within the next ``most`` bytes, -1 if there is none."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark) + 1))) < 0 and (most is None or len(self.held) < most):
            seen = len(self.held)
            if not self.more():
                return -1
        return at if most is None or at + len(mark) <= most else -1

    def take(self, n: int, keep: bool = True) -> bytes:
        if not keep and self.plain and n > len(self.held):
            self.plain.seek(n - len(self.held) - 1, 1)
            self.held = bytearray(self.plain.read(1))  # the last byte shows that the file holds it
            n = 1
        while len(self.held) < n:
            if not keep:
                n -= len(self.held)
                self.held.clear()
            if not self.more():
                raise ValueError("a record has no end")
        out = bytes(self.held[:n]) if keep else b""
        del self.held[:n]
        return out


def _records(feed: _Feed, want_payload: bool, tests: list):
    """(header columns, payload or None) of the records that pass, whatever they are packed in."""
    while True:
        while not (blank := feed.held.lstrip(b"\r\n")) and feed.more():
            pass
        if not blank:
            return
        feed.held = blank
        end = feed.upto(b"\r\n\r\n")
        if end < 0:
            raise ValueError("a record's header has no end")
        columns = header_columns(feed.take(end))
        feed.take(4)
        left = columns["length"]
        if columns["http"] and (head := feed.upto(b"\r\n\r\n", left)) >= 0:
            feed.take(head + 4)
            left -= head + 4
            columns["payload_bytes"] = left
        ok = passes(tests, columns)
        payload = feed.take(left, keep=ok and want_payload)
        if ok:
            yield columns, payload if want_payload else None


def read_members(stream, want_payload: bool, tests: list):
    """(header columns, payload or None) of the records that pass. In this writer's members the
    header block is inflated first, and the rest only where the payload is wanted."""
    at = 0
    while True:
        stream.seek(at)
        raw = stream.read(_READ)
        if not raw:
            return
        if raw[:2] != b"\x1f\x8b" and not at:
            stream.seek(0)
            yield from _records(_Feed(plain=stream), want_payload, tests)
            return
        if raw[3:4] != b"\x04" or raw[12:14] != b"sl":
            yield from _records(_Feed(_inflated(stream, at)), want_payload, tests)
            return
        inflate, out = zlib.decompressobj(31), bytearray()
        out += inflate.decompress(raw)

        def more(inflate=inflate):
            part = stream.read(_READ)
            if not part:
                raise ValueError("a record ends before its gzip member does")
            return inflate.decompress(part)

        while (end := out.find(b"\r\n\r\n")) < 0:
            out += more()
        columns = header_columns(bytes(out[:end]))
        ok = passes(tests, columns)
        if ok and want_payload:
            while not inflate.eof:
                out += more()
            yield columns, bytes(out[end + 4:end + 4 + columns["length"]])
        elif ok:
            yield columns, None
        at += struct.unpack_from("<Q", raw, 16)[0]


# ---- data source ---------------------------------------------------------------------------

@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, int], ...]


class WarcSource(DataSource):
    """Options: path; file_bytes (rolls a task's files); partition_bytes (files per partition);
    verify (true: digest and length of responses come from their payloads)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options))


class WarcWriter(DataSourceWriter):
    """Rows (record_type, target_uri, page_id, payload, payload_digest, payload_bytes, refers_to)."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.roll = int(options.get("file_bytes", 64 << 20))

    def write(self, iterator) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size, name = [], None, 0, ""
        for row in iterator:
            if out is None:
                name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = member(record(row.record_type, row.target_uri, row.page_id, bytes(row.payload or b""), row.payload_digest,
                                 row.payload_bytes, row.refers_to))
            out.write(data)
            size += len(data)
            if size >= self.roll:
                out.close()
                files.append((name, size))
                out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(tuple(files))

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        listed = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        fs, root = _filesystem(self.path)
        for name, _ in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{root}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("partition_bytes", 32 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.columns, self.tests = columns, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull, EqualNullSafe)):
                kind = {EqualTo: "equal", In: "in", StringStartsWith: "starts", IsNotNull: "some", EqualNullSafe: "null safe"}[type(f)]
                self.tests.append((kind, column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Files((root,))]
        listed = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = []
        for info in listed:
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path, compression=None) as f:
                    files += json.loads(f.read())
        if not any(i.base_name.startswith("manifest-") for i in listed):  # an archive by another writer
            files = [(i.base_name, i.size) for i in listed if i.base_name.endswith((".warc.gz", ".warc"))]
        parts, held, size = [], [], 0
        for name, n in sorted(files):
            if held and size + n > self.most:
                parts.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f"{root}/{name}")
            size += n
        return [*parts, Files(tuple(held))] if held or not parts else parts

    def read(self, partition: Files):
        fs, _ = _filesystem(self.path)
        want = "payload" in self.columns or self.verify and {"payload_bytes", "payload_digest"} & set(self.columns)
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for columns, payload in read_members(stream, bool(want), self.tests):
                    if payload is not None and self.verify and columns["record_type"] != "revisit":
                        columns |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
                    yield tuple(columns.get(c) if c != "payload" else payload for c in self.columns)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark offer filters to Python readers (off by default)."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages ---------------------------------------------------------------------------------

def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                    least_bytes: int = 1000) -> DataFrame:
    """One record row per page. Which of equal payloads is the response is settled on slim rows
    (digest, length, id): a group of any size is pre-aggregated to its largest id. Payloads of
    revisits are dropped before anything is written."""
    pages = materialize(
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
                     F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
        .select("*", F.monotonically_increasing_id().alias("row"), F.sha1("payload").alias("payload_digest"),
                F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-pages", compression="zstd")
    key = ["payload_digest", "payload_bytes"]
    first = (pages.filter(F.col("payload_bytes") >= least_bytes).groupBy(*key)
             .agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
             .select(*key, F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")))
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return pages.join(first, key, "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "page_id",
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes",
        F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Writes one WARC record per page and returns the archive's folder (in the shared folder)."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_dir(spark, "warc")
    archive_records(pages, **columns).write.format("warc").mode("append").option("path", path).save()
    return path


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """``columns`` as DDL: without payload, none is decoded."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)
