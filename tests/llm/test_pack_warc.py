import gzip
import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedlens.llm import packing, warc
from feedlens.llm.queries import op9_warc_pages, tokenizer_path
from tests.conftest import SF


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab's ,.\n\t 　\x1cé1 2<|>", max_size=25), max_size=4))
def test_encoder_equals_the_tokenizer(encoder, tokenizer, ts):
    ts = [*ts, "x <|endoftext|> y", "a\x00 b", "  two  spaces \n next", "a,b. C.D, é, ñ. ª², ß,,\nThe end.", "\n", "one\n", "I'll we've 12x", "x" * 500, "é" * 300, "\t\r\n \x0b"]
    assert encoder(pa.array(ts, pa.string())) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(ts, add_special_tokens=False)]


def check_pack(rows, ids_of, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(ids_of)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0


def test_pack_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids_of = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    check_pack(packing.pack(docs.repartition(3), tokenizer_path()).collect(), ids_of, 2048)
    check_pack(packing.pack(docs, tokenizer_path(), capacity=64, with_ids=True).collect(), ids_of, 64)


def test_pack_edges(spark, tokenizer):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "a " * 5000), (5, "x")], "doc_id long, text string").selectExpr("*", "1 as start", "2 as ids")
    ids_of = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    check_pack(packing.pack(docs, tokenizer_path()).collect(), ids_of, 2048)
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []
    twice = packing.pack(docs.filter("doc_id = 4").union(docs.filter("doc_id = 4")), tokenizer_path()).collect()
    assert sum(r.length for r in twice) == 2 * len(ids_of[4])
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), capacity=1000)


def packed_rows(lengths, capacity):
    packer, out, kinds = packing.Packer(0, capacity), [], []
    for doc, n in enumerate(lengths):
        out += packer.add(doc, np.arange(n, dtype="<u4").tobytes())
        held = [(k, len(v)) for k, v in packer.open.items()]
        assert all(m < k for k, m in held)  # fewer documents than a bin of the class takes
    return [*out, *packer.finish()]


@pytest.mark.parametrize("top", [40, 300, 2048, 6000])
def test_packer_by_classes(top):
    rng = np.random.default_rng(top)
    lengths = rng.integers(1, top + 1, 4000).tolist()
    rows = packed_rows(lengths, 2048)
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r[6]].append(r)
        docs[r[0]].append(r)
        assert r[3] == zlib.crc32(np.arange(r[1], r[1] + r[2], dtype="<u4").tobytes()) == zlib.crc32(r[5])
    for doc, n in enumerate(lengths):
        at = 0
        for r in sorted(docs[doc], key=lambda r: r[1]):
            assert r[1] == at and r[4] == n
            at += r[2]
        assert at == n
    sizes = [sum(r[2] for r in s) for s in seqs.values()]
    assert all(n & (n - 1) == 0 and n <= 2048 for n in sizes) and sum(n < 2048 for n in sizes) <= 11
    if top <= 2048:
        assert len(rows) < 2 * len(lengths) and len(rows) <= len(lengths) + len(seqs)  # one cut a bin
        whole = [s for s in seqs.values() if sum(r[2] for r in s) == 2048]
        # but for a worker's last bins, a bin holds the k documents of one class and then its filling
        assert sum(any(len(s) > k and {2048 // r[2] for r in s[:k]} == {k} for k in (2048 // s[0][2],)) or len(s) == 2048 // s[0][2]
                   for s in whole) > 0.9 * len(whole) - 60


def test_packer_of_few_documents():
    assert packed_rows([], 8) == []
    assert [(r[0], r[1], r[2], r[6], r[7]) for r in packed_rows([8, 3, 5], 8)] == [(0, 0, 8, 0, 0), (2, 0, 5, 1, 0), (1, 0, 3, 1, 5)]
    assert [(r[0], r[1], r[2], r[6], r[7]) for r in packed_rows([7], 8)] == [(0, 0, 4, 0, 0), (0, 4, 2, 1, 0), (0, 6, 1, 2, 0)]
    assert [r[2] for r in packed_rows([1] * 8, 8)] == [1] * 8


def brute_pages(rows, least=1000):
    groups = defaultdict(list)
    for i, h in rows:
        groups[h or ""].append(i)
    out = []
    for h, ids in groups.items():
        big = len(h.encode()) >= least
        first = max(ids, key=lambda i: -1 if i is None else i)
        used = False
        for i in sorted(ids, key=lambda i: -1 if i is None else i, reverse=True):
            response = not big or i == first and not used
            used |= i == first
            out.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=repr)


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def test_warc_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, op9_warc_pages(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute_pages(rows)


def test_warc_edges_and_round_trip(spark):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, long), (9, long), (9, long), (None, long), (2, None), (3, ""), (4, "x" * 999), (5, "x" * 999), (6, "y" * 1_000_000)]
    pages = spark.createDataFrame([(i, f"http://e.x/{i} ü%20", h, "z") for i, h in rows], "page_id long, url string, html string, record_type string")
    path = warc.write_archive(pages)
    got = warc.read_archive(spark, path)
    cols = [c.split()[0] for c in COLUMNS.split(", ")]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == brute_pages(rows)
    assert sorted(map(tuple, warc.read_archive(spark, path, COLUMNS, verify=True).collect()), key=repr) == brute_pages(rows)
    full = {r.page_id: r for r in got.collect()}
    assert bytes(full[6].payload) == b"y" * 1_000_000 and bytes(full[9].payload) in (b"", long.encode())
    assert full[2].target_uri == "http://e.x/2 ü%20"
    empty = warc.write_archive(pages.limit(0))
    assert warc.read_archive(spark, empty).collect() == []


def test_warc_filters_are_pushed_down(spark):
    long = "w" * 2000
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.x/", long if i < 4 else str(i)) for i in range(10)], "page_id long, url string, html string")
    df = warc.read_archive(spark, warc.write_archive(pages))
    kept = df.filter("record_type = 'revisit' and target_uri like 'http://h1%'")
    assert sorted((r.page_id, r.refers_to) for r in kept.collect()) == [(1, 3)]
    assert df.filter("page_id in (5, 6)").count() == 2 and df.filter("payload_bytes > 100").count() == 4
    reader = warc.WarcReader({"path": "x"}, ["page_id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 1)])) == [GreaterThan(("payload_bytes",), 1)]
    assert reader.tests == [("equal", "record_type", "response")]


def test_skipped_payloads_are_not_inflated():
    import io

    big = b"".join(warc.member(warc.record("response", None, i, os.urandom(300_000), "00" * 20, 300_000, None)) for i in range(3))

    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            out = super().read(size)
            Counting.n += len(out)
            return out

    assert [c["page_id"] for c, _ in warc.read_members(Counting(big), False, [])] == [0, 1, 2]
    assert Counting.n <= 4 * (1 << 16) < len(big) / 3


def test_archives_of_other_writers(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/%20\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"hello", b"world").replace(b"response", b"resource")))
    rows = warc.read_archive(spark, str(tmp_path)).collect()
    assert [(r.record_type, bytes(r.payload), r.target_uri, r.payload_bytes) for r in rows] == [
        ("response", b"hello", "http://a/%20", 5), ("resource", b"world", "http://a/%20", 5)]


def test_uncommitted_files_are_not_read(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    path = warc.write_archive(pages)
    local = path.replace("file:", "")
    with open(os.path.join(local, "stray.warc.gz"), "wb") as f:
        f.write(b"not a record")
    assert warc.read_archive(spark, path).count() == 1


def foreign(kind: str, body: bytes, content: str = "text/plain", uri: str = "http://a/") -> bytes:
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {content}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_several_records_in_a_member(spark, tmp_path):
    bodies = [b"one", b"\r\n\r\nWARC/1.0\r\n", b"", os.urandom(200_000), b"last"]
    parts = [foreign("response" if i % 2 else "resource", b, uri=f"http://a/{i}") for i, b in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(parts[0] + parts[1]) + gzip.compress(b"".join(parts[2:])) + b"\0" * 512)
    got = warc.read_archive(spark, str(tmp_path))
    assert [bytes(r.payload) for r in got.collect()] == bodies
    assert [r.target_uri[-1] for r in got.filter("record_type = 'response'").select("target_uri", "record_type").collect()] == ["1", "3"]


def test_records_across_members_and_cut_files():
    import io

    data = b"".join(foreign("response", os.urandom(3000)) for _ in range(4))
    packed = gzip.compress(data[:5000]) + gzip.compress(data[5000:])
    assert len(list(warc.read_members(io.BytesIO(packed), True, []))) == 4
    for cut in (packed[:-40], packed[:30]):
        for want in (True, False):
            with pytest.raises(ValueError):
                list(warc.read_members(io.BytesIO(cut), want, []))
    for want in (True, False):
        with pytest.raises(ValueError):
            list(warc.read_members(io.BytesIO(data[:-1500]), want, []))


def test_plain_archives(spark, tmp_path):
    bodies = [os.urandom(150_000), b"", b"x" * 70_000, b"end"]
    (tmp_path / "a.warc").write_bytes(b"".join(foreign("response", b, uri=f"http://a/{i}") for i, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(b"")
    assert [bytes(r.payload) for r in warc.read_archive(spark, str(tmp_path)).collect()] == bodies
    rows = warc.read_archive(spark, str(tmp_path), "target_uri string, payload_bytes long").collect()
    assert [(r.target_uri, r.payload_bytes) for r in rows] == [(f"http://a/{i}", len(b)) for i, b in enumerate(bodies)]


def test_http_heads_are_no_payload(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    http = "application/http; msgtype=response"
    parts = [foreign("response", head + b"<p>a</p>", http), foreign("response", head, http), foreign("response", b"no head", http),
             foreign("resource", head + b"kept", "text/plain")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    want = [b"<p>a</p>", b"", b"no head", head + b"kept"]
    assert [(bytes(r.payload), r.payload_bytes) for r in warc.read_archive(spark, str(tmp_path)).collect()] == [(w, len(w)) for w in want]
    slim = warc.read_archive(spark, str(tmp_path), "payload_bytes long, record_type string").filter("record_type = 'response'")
    assert [r.payload_bytes for r in slim.collect()] == [8, 0, 7]
