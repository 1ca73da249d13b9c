"""Texts as zstd bytes, for jobs that shuffle whole texts several times: Spark's own block codec sees
a row's text beside others in small blocks and keeps about 1.6 times as much, and Spark has no
expression that compresses. Arrow-batched; null stays null, and bytes are kept as they are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = 8  # bytes of a text's length before its frame


def pack(text) -> Column:
    """``text`` (string) as binary."""
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        codec, out = pa.Codec("zstd"), []
        for t in texts:
            raw = t.as_buffer()
            out.append(None if raw is None else raw.size.to_bytes(_HEAD, "little") + codec.compress(raw, asbytes=True))
        return pa.array(out, pa.binary())

    return packed(F.col(text) if isinstance(text, str) else text)


def unpack(data) -> Column:
    """The text that ``pack`` was given. Not repeated by the optimizer (filters on it stay above)."""
    @F.arrow_udf("string")
    def unpacked(rows: pa.Array) -> pa.Array:
        codec, out = pa.Codec("zstd"), []
        for r in rows:
            raw = r.as_buffer()
            size = 0 if raw is None else int.from_bytes(raw[:_HEAD], "little")
            out.append(None if raw is None else codec.decompress(raw[_HEAD:], size, asbytes=True) if size else b"")
        return pa.array(out, pa.binary()).view(pa.string())

    return unpacked.asNondeterministic()(F.col(data) if isinstance(data, str) else data)
