"""Removal of repeated passages by difference-cover anchors.

Method: a perfect difference set D modulo p holds, for every pair of positions i and j, a shift
d < p with both (i + d) mod p and (j + d) mod p in D. Hashing the runs of ``window - p + 1``
words that start at cover positions only (|D| of p positions) is therefore enough: two equal
windows of ``window`` words always share an aligned anchor run. Anchors that occur once rule
out every window around them. Around repeated anchors the match is extended: the whole windows
that hold the anchor are hashed, and those that occur twice or more mark their words.

Layout. Documents are packed into chunks of bounded bytes (all columns, compressed), written
once to the shared folder. Each chunk sends its distinct hashes, sorted and cut by hash bits
into buckets, and gets back one bit per hash: "another chunk has it". So the shuffled volume is
a few bytes per anchor, a passage that a million documents share travels once per chunk, and no
pairs are formed. A task holds one chunk, of bounded bytes, or one bucket of hashes. A bucket's
size follows the number of buckets (``bucket_bytes``), but for a hash that stands in every chunk: it
is there once per chunk. From about 17 bucket bits on (3 TB of text at the defaults) a chunk's rows
hold about one hash each, and the row's own bytes outweigh the hash. Windows compare by 64 hash bits plus the independent bits that chose the bucket.

Defined cases: null and empty texts have no words and nothing removed, kept text empty. Texts
shorter than a window lose nothing. Overlapping repeats inside one text count as repeats.
Repeated rows are repeats of each other. Result columns n_words, n_removed and kept_text replace
input columns of the same name; all other columns pass through. An empty table stays empty.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.llm.words import byte_slices, mix, text_buffers, window_hashes, word_hashes, word_spans
from feedlens.sources.files import materialize

# Perfect difference sets (every nonzero residue is a difference of two members).
DIFFERENCE_SETS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_LOW48 = (1 << 48) - 1


def cover_period(window: int) -> int:
    """Largest period whose anchors still span half of the window; 1 (every position) below that."""
    return max([p for p in DIFFERENCE_SETS if window - p + 1 >= max(2, window // 3)], default=1)


def _to_chunks(text_col: str, chunk_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def chunk():
            nonlocal made, held, size
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for b in held:
                    out.write_batch(b)
            row = pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([size]),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             ["chunk", "n_bytes", "rows"])
            made, held, size = made + 1, [], 0
            return row

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for first, last in byte_slices(batch.column(at), chunk_bytes):
                part = batch.slice(first, last - first)
                n = int(text_buffers(part.column(at))[1][-1])
                if held and size + n > chunk_bytes:
                    yield chunk()
                held.append(part)
                size += n
        if held:
            yield chunk()

    return run


def _open(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


class _Chunk:
    """The hashes of one chunk; every pass rebuilds them in the same order."""

    def __init__(self, table: pa.Table, text_col: str, window: int, period: int):
        self.window, self.period = window, period
        self.data, self.offsets = text_buffers(table.column(text_col))
        starts, ends, self.first = word_spans(self.data, self.offsets)
        self.words = word_hashes(self.data, starts, ends)
        self.counts = np.diff(self.first)
        n = len(self.words)
        self.begin = np.repeat(self.first[:-1], self.counts)  # first word of the word's text
        self.left = np.repeat(self.first[1:], self.counts) - np.arange(n)  # words from here to its end
        whole = np.repeat(self.counts >= window, self.counts)
        cover = np.zeros(max(period, 1), bool)
        cover[list(DIFFERENCE_SETS.get(period, (0,)))] = True
        run = window - period + 1
        self.anchor_at = np.flatnonzero(whole & (self.left >= run) & cover[(np.arange(n) - self.begin) % period])
        self.anchors = window_hashes(self.words, run)[self.anchor_at]

    def anchor_keys(self, bits: int):
        """(sorted distinct (bucket, value), index of each anchor, repeated here)."""
        bucket = (self.anchors >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.anchors), np.int64)
        if bits <= 16:
            value = self.anchors >> np.uint64(16 - bits) & np.uint64(_LOW48)
        else:
            value = self.anchors & np.uint64((1 << 64 - bits) - 1)
        return _distinct(bucket, value)

    def candidates(self, repeated: np.ndarray):
        """Starts of the windows that hold a repeated anchor."""
        n = len(self.words)
        p = self.anchor_at[repeated]
        low = np.maximum(p - self.period + 1, self.begin[p])
        change = np.bincount(low, minlength=n + 1) - np.bincount(p + 1, minlength=n + 1) if len(p) else np.zeros(n + 1, np.int64)
        return np.flatnonzero((np.cumsum(change)[:n] > 0) & (self.left >= self.window))

    def window_keys(self, at: np.ndarray, bits: int):
        value = window_hashes(self.words, self.window)
        value = value[at] if len(value) else np.zeros(0, np.uint64)
        other = window_hashes(mix(self.words, ~self.words), self.window)
        other = other[at] if len(other) else np.zeros(0, np.uint64)
        return _distinct((other >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64), value)

    def removed(self, starts: np.ndarray) -> np.ndarray:
        """Which words a repeated window covers."""
        n = len(self.words)
        if not len(starts):
            return np.zeros(n, bool)
        change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + self.window, minlength=n + 1)
        return np.cumsum(change)[:n] > 0


def _distinct(bucket: np.ndarray, value: np.ndarray):
    order = np.lexsort((value, bucket))
    b, v = bucket[order], value[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (v[1:] != v[:-1])] if len(b) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    index = np.empty(len(order), np.int64)
    index[order] = group
    return b[new], v[new], index, np.bincount(group, minlength=int(new.sum())) > 1


def _bucket_rows(chunk: int, bucket: np.ndarray, value: np.ndarray, width: int) -> pa.Table:
    """One row per bucket with its values, ``width`` bytes each."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    raw = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    ends = np.r_[cuts[1:], len(bucket)] * width
    blobs = [raw[s * width:e] for s, e in zip(cuts.tolist(), ends.tolist(), strict=True)] if len(cuts) else []
    return pa.table({"chunk": pa.array(np.full(len(cuts), chunk, np.int64)), "bucket": pa.array(bucket[cuts]),
                     "hashes": pa.array(blobs, pa.binary())})


_HASH_ROWS = "chunk long, bucket long, hashes binary"


def _shared(width: int):
    """Per bucket: for each chunk's hashes, one bit each: it occurs in two chunks or more."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("hashes").to_pylist()
        sizes = np.array([len(b) // width for b in blobs])
        flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        wide = np.zeros((len(flat), 8), np.uint8)
        wide[:, :width] = flat
        values = wide.view("<u8").ravel()
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        twice = np.zeros(len(values), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cuts = np.r_[0, np.cumsum(sizes)]
        bits = [np.packbits(twice[s:e]).tobytes() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def _elsewhere(bucket: np.ndarray, reply: pa.Table) -> np.ndarray:
    """The reply's bits in the order of the chunk's sorted distinct hashes."""
    out = np.zeros(len(bucket), bool)
    for b, bits in zip(reply.column("bucket").to_pylist(), reply.column("bits").to_pylist(), strict=True):
        s, e = np.searchsorted(bucket, [b, b + 1])
        out[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, period: int | None = None,
                   chunk_bytes: int = 4 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a run of ``window`` words that covers it also starts anywhere else in the
    table. ``bucket_bytes``: text bytes per hash bucket, which bounds the reducing tasks.
    """
    period = period or cover_period(window)
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("kept_text", T.StringType())]
    names = {f.name.lower() for f in extra}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    chunks = materialize(docs.mapInArrow(_to_chunks(text_col, chunk_bytes), "chunk long, n_bytes long, rows binary"), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(32, max(2, int(total // bucket_bytes).bit_length()))

    def anchors(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bucket, value, _, _ = _Chunk(_open(blob.as_buffer()), text_col, window, period).anchor_keys(bits)
                yield from _bucket_rows(chunk, bucket, value, 6).to_batches()

    shared = "chunk long, bucket long, bits binary"
    seen = materialize(chunks.select("chunk", "rows").mapInArrow(anchors, _HASH_ROWS)
                       .groupBy("bucket").applyInArrow(_shared(6), shared).withColumn("step", F.lit(0)), "anchors")

    def candidate_windows(c: _Chunk, reply: pa.Table):
        bucket, _, index, here = c.anchor_keys(bits)
        at = c.candidates((_elsewhere(bucket, reply) | here)[index])
        return at, *c.window_keys(at, bits)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("rows"), strict=True):
            _, bucket, value, _, _ = candidate_windows(_Chunk(_open(blob.as_buffer()), text_col, window, period), right)
            made.append(_bucket_rows(chunk, bucket, value, 8))
        return pa.concat_tables(made) if made else _bucket_rows(0, np.zeros(0, np.int64), np.zeros(0, np.uint64), 8)

    by_chunk = chunks.select("chunk", "rows").groupBy("chunk")
    matched = materialize(by_chunk.cogroup(seen.groupBy("chunk")).applyInArrow(extend, _HASH_ROWS)
                          .groupBy("bucket").applyInArrow(_shared(8), shared).withColumn("step", F.lit(1)), "windows")

    schema = T.StructType([*docs.schema.fields, *extra])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        step = right.column("step").to_numpy()
        for blob in left.column("rows"):
            table = _open(blob.as_buffer())
            c = _Chunk(table, text_col, window, period)
            at, bucket, _, index, here = candidate_windows(c, right.filter(pa.array(step == 0)))
            twice = _elsewhere(bucket, right.filter(pa.array(step == 1))) | here
            gone = c.removed(at[twice[index]])
            n_gone = np.add.reduceat(np.r_[gone, False].astype(np.int64), c.first[:-1]) * (c.counts > 0) if len(c.counts) else c.counts
            raw, kept = c.data.tobytes(), []
            for s, e, w, n in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), c.first[:-1].tolist(), n_gone.tolist(), strict=True):
                words = raw[s:e].split()
                kept.append(b" ".join(compress(words, ~gone[w:w + len(words)]) if n else words))
            for name, col in (("n_words", pa.array(c.counts)), ("n_removed", pa.array(n_gone)),
                              ("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))):
                table = table.append_column(name, col)
            made.append(table)
        return pa.concat_tables(made) if made else pa.table({f.name: pa.array([]) for f in schema}).slice(0, 0)

    return by_chunk.cogroup(seen.unionByName(matched).groupBy("chunk")).applyInArrow(cut, schema)
