"""Words of whole texts as numpy spans over Arrow buffers.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``. These separators are
single UTF-8 bytes that never occur inside a longer character, so byte spans equal the
code-point words ``[^\\x20\\x09-\\x0D]+``. All functions see one bounded slice of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, first word of each text) with one more entry than texts in the last."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = _SEP[data]
    before = np.empty(len(data) + 1, dtype=bool)  # a separator or a text's border lies before byte i
    before[0] = before[-1] = True
    before[1:-1] = sep[:-1]
    before[offsets] = True
    starts = np.flatnonzero(~sep & before[:-1])
    after = np.empty(len(data), dtype=bool)
    after[:-1] = sep[1:]
    after[-1] = True
    cut = offsets[(offsets > 0)] - 1
    after[cut] = True
    ends = np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit hash of two 64-bit hashes."""
    x = a * _M1 + b * _ODD
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: a prefix sum of ``byte * base**position`` gives every
    word's polynomial in one pass; dividing by ``base**start`` makes it position-free."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h, (ends - starts).astype(np.uint64))


_POWERS: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inv = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inv)]
    return _POWERS[0], _POWERS[1]


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by doubling; entry i starts at word i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, power, span = None, 0, words, 1
    while True:
        if length & span:
            part = power[covered:]
            out = part[:n].copy() if out is None else mix(out, part[:n])
            covered += span
        if covered == length:
            return out
        power = mix(power[:-span], power[span:])
        span *= 2


def byte_slices(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` text bytes each (one longer text stands alone)."""
    lengths = np.diff(text_buffers(column)[1]) if len(column) else np.zeros(0, np.int64)
    out, first, held = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and held + n > limit:
            out.append((first, i))
            first, held = i, 0
        held += n
    if len(lengths):
        out.append((first, len(lengths)))
    return out


def sliced(batches, column: str, limit: int = 4 << 20):
    """Record batches cut to at most ``limit`` bytes of text, so numpy temporaries stay bounded."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for first, last in byte_slices(batch.column(at), limit):
            yield batch.slice(first, last - first)
