"""CSV read by byte ranges against Spark's multi-line reader and Python's csv module."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.session import shared_dir
from feedlens.sources import csv_ranges as cr
from feedlens.sources import files as fl

TEXTS = ["a,b\n", '"x"\n"y\nz"\n', '"a ""q"" b","l1\nl2\r\nl3",c\r\n\n"",""\n', 'h\n"\n\n\n"\n"""\n"""\nend', "\n\n", "", '"""",""""""\n"\n"', "é,\"ü\n😀\"\nß"]


def records(text: bytes, cuts):
    """Records by ranges between ``cuts``, with the quotes counted as the first pass does."""
    out, stream = [], pa.BufferReader(text)
    cuts = [0, *cuts, len(text)]
    seen = 0
    for a, b in zip(cuts, cuts[1:]):
        for part in cr.range_records(stream, len(text), a, b, seen % 2 == 1):
            out += part.to_pylist()
        seen += cr.count_quotes(stream, a, b)
    return out


def whole(text: bytes):
    """Records by a scan over the characters."""
    out, now, inside = [], "", False
    for c in text.decode():
        inside ^= c == '"'
        now += c
        if c == "\n" and not inside:
            out, now = [*out, now.rstrip("\r\n")], ""
    return [r for r in [*out, now.rstrip("\r\n")] if r]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_every_split_offset(monkeypatch, chunk):
    monkeypatch.setattr(cr, "_CHUNK", chunk)
    for text in TEXTS:
        data = text.encode()
        if whole(data) and data.count(b'"') % 2:
            with pytest.raises(ValueError):
                records(data, [])
            continue
        for cut in range(len(data) + 1):
            assert records(data, [cut]) == whole(data), (text, cut)
        assert records(data, range(1, len(data))) == whole(data)
        rng = random.Random(1)
        for _ in range(50):
            assert records(data, sorted(rng.choices(range(len(data) + 1), k=3))) == whole(data)


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("note", T.StringType()),
                       T.StructField("x", T.DoubleType())])


def write(spark, rows, eol="\n", files=1):
    import os

    folder = shared_dir(spark, "csv-ranges-test").replace("file:", "")
    for n in range(files):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=eol)
        w.writerow(["id", "text", "note", "x"])
        w.writerows(rows[n::files])
        with open(os.path.join(folder, f"part-{n}.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(out.getvalue())
    return folder


def rows_of(n, seed=2):
    rng = random.Random(seed)
    bits = ['"', '""', ",", "\n", "\r\n", " ", "word", "é😀", "NA", "'", "\\"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    return [(i, text(), rng.choice([None, "plain", text()]), rng.choice([None, 0.5, -3])) for i in range(n)]


@pytest.mark.parametrize("eol,files", [("\n", 1), ("\r\n", 3)])
def test_rows_equal_the_multi_line_reader(spark, eol, files):
    path = write(spark, rows_of(400), eol, files)
    want = [(i, text or None, note or None, x) for i, text, note, x in rows_of(400)]
    if eol == "\n":  # the other reader turns CRLF inside cells of CRLF files into LF; here cells stay as they are
        assert sorted(map(tuple, fl.read_csv(spark, path, SCHEMA, range_bytes=None).collect())) == want
    for step in (64, 1000, 1 << 20):
        assert sorted(map(tuple, fl.read_csv(spark, path, SCHEMA, range_bytes=step).collect())) == want


def test_one_large_file_is_read_by_many_tasks(spark):
    rows = [(i, f'line {i}\n"quoted", {"x" * (i % 900)}', None, i / 2) for i in range(40_000)]
    path = write(spark, rows)
    df = fl.read_csv(spark, path, SCHEMA, range_bytes=1 << 20)
    per_task = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 15 and max(r["count"] for r in per_task) < 4000
    sums = lambda d: d.agg(F.count("*"), F.sum("id"), F.sum(F.xxhash64("text", "note", "x").cast("decimal(38,0)"))).first()
    assert sums(df) == sums(fl.read_csv(spark, path, SCHEMA, range_bytes=None))


def test_odd_files(spark):
    import gzip
    import os

    folder = write(spark, rows_of(60))
    want = sorted(map(tuple, fl.read_csv(spark, folder, SCHEMA, range_bytes=None).collect()))
    packed = shared_dir(spark, "csv-packed").replace("file:", "")
    with open(f"{folder}/part-0.csv", "rb") as f, gzip.open(f"{packed}/a.csv.gz", "wb") as g:
        g.write(f.read())
    open(os.path.join(packed, "b.csv"), "w").close()
    open(os.path.join(packed, "_SUCCESS"), "w").close()
    assert sorted(map(tuple, fl.read_csv(spark, packed, SCHEMA, range_bytes=50).collect())) == want
    empty = shared_dir(spark, "csv-empty")
    assert fl.read_csv(spark, empty, SCHEMA).collect() == []
    with open(os.path.join(packed, "c.csv"), "w") as f:
        f.write('id,text,note,x\n1,"open,a,2\n')
    with pytest.raises(ValueError, match="pair up"):
        fl.read_csv(spark, packed, SCHEMA)
