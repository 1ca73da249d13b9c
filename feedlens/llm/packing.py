"""Harmonic packing of token sequences without padding.

Method: a document of at most ``capacity`` tokens falls into the reciprocal-capacity class k with
capacity / (k + 1) < tokens <= capacity / k, for every k, and a bin of class k takes k whole
documents of its class. What such a bin lacks is cut from the next document, whose rest is classed
anew, so there is one cut a bin at most. Of longer documents whole bins are cut first, and their
rest is a document as any other. Each worker fills the bins of its own classes and needs no other
worker: it holds at most k - 1 documents a class and one bin that lacks its filling. What is left
when a worker ends is strung together, class by class, into full bins, and the last one is cut into
powers of two, which are not padded either.

Nothing is shuffled: tokenising and packing run in one pass over the input's partitions. A
sequence id is (partition number, counter), unique and equal on a rerun of the same input.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed as often as
they occur. An empty table gives no piece. Columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from feedlens.llm.words import sliced

def byte_letters() -> dict[str, int]:
    """The byte of each letter of the vocabulary file: printable Latin-1 characters stand for
    themselves, the characters from U+0100 on for the other bytes, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(0x100 + k): b for k, b in enumerate(others)}}


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, by a byte-level BPE file of the
    ``tokenizers`` library.

    A byte-level BPE's ids are its merge ranks, so the vocabulary that ``tokenizers`` reads is
    also handed to ``tiktoken``, which merges the same pairs several times faster. It encodes the
    texts of ASCII and Latin-1 letters, on which the two libraries' patterns can't differ; every
    other text, and any that holds a special token's string, is encoded by ``tokenizers`` itself,
    special strings as ordinary text. The tests hold both ways against ``tokenizers`` alone.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, special = byte_letters(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = "|".join([r"[^\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]", r"[\x1c-\x1f]", *map(re.escape, special)])

    def __call__(self, column: pa.Array) -> list[bytes]:
        import numpy as np

        column = pc.fill_null(column.cast(pa.large_string()), "")
        slow = pc.match_substring_regex(column, self.slow).to_pylist()
        fast, whole = self.fast.encode_to_numpy, self.tokenizer.encode
        return [np.array(whole(t, add_special_tokens=False).ids, "<u4").tobytes() if s else
                fast(t, disallowed_special=()).astype("<u4", copy=False).tobytes()
                for t, s in zip(column.to_pylist(), slow, strict=True)]


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker: it outlives a task, as loading it takes a while. The registry
    is a module of the process, as functions sent by value have their own globals in each task."""
    import sys
    import types

    kept = sys.modules.setdefault("feedlens_worker_encoders", types.ModuleType("feedlens_worker_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


class Packer:
    """One worker's bins over documents as (doc, start, tokens, document's tokens) with 4 bytes a
    token. ``add`` and ``finish`` return the pieces (doc, start, length, crc32, document's tokens,
    tokens, sequence, offset) of bins that became full."""

    def __init__(self, first_id: int, capacity: int):
        self.next, self.capacity = first_id, capacity
        self.open: dict[int, list[tuple]] = {}
        self.lacking: list[tuple] = []  # a bin that has its documents, and how much it lacks
        self.gap = 0

    def _close(self, items: list[tuple]) -> list[tuple]:
        sequence, self.next, at, out = self.next, self.next + 1, 0, []
        for doc, start, tokens, total in items:
            n = len(tokens) // 4
            out.append((doc, start, n, zlib.crc32(tokens), total, tokens, sequence, at))
            at += n
        return out

    def _cut(self, item: tuple, n: int) -> tuple[tuple, tuple | None]:
        """The first ``n`` tokens of a document and its rest, None if there is none."""
        doc, start, tokens, total = item
        rest = (doc, start + n, tokens[4 * n:], total)
        return (doc, start, tokens[:4 * n], total), rest if rest[2] else None

    def _fill(self, item: tuple) -> tuple[list[tuple], tuple | None]:
        """Gives a document to the bin that lacks something: (pieces, its rest)."""
        head, rest = self._cut(item, self.gap)
        self.lacking.append(head)
        self.gap -= len(head[2]) // 4
        if self.gap:
            return [], rest
        items, self.lacking = self.lacking, []
        return self._close(items), rest

    def add(self, doc, tokens: bytes) -> list[tuple]:
        item, out, total = (doc, 0, tokens, len(tokens) // 4), [], len(tokens) // 4
        for _ in range(total // self.capacity):
            head, item = self._cut(item, self.capacity)
            out += self._close([head])
        if item and self.gap:
            done, item = self._fill(item)
            out += done
        if item:
            k = self.capacity // (len(item[2]) // 4)
            held = self.open.setdefault(k, [])
            held.append(item)
            if len(held) == k:
                del self.open[k]
                self.lacking, self.gap = held, self.capacity - sum(len(i[2]) for i in held) // 4
                if not self.gap:
                    self.lacking, done = [], self._close(held)
                    out += done
        return out

    def finish(self) -> list[tuple]:
        out = []
        for item in [i for _, items in sorted(self.open.items()) for i in items]:
            while item:
                if not self.gap:
                    self.gap = self.capacity
                done, item = self._fill(item)
                out += done
        rest, self.lacking, self.open = self.lacking, [], {}
        left = sum(len(i[2]) for i in rest) // 4
        now: list[tuple] = []
        gap = size = 1 << max(left.bit_length() - 1, 0)
        for item in rest:
            while item:
                head, item = self._cut(item, gap)
                now.append(head)
                gap -= len(head[2]) // 4
                if not gap:
                    out += self._close(now)
                    left, now = left - size, []
                    gap = size = 1 << max(left.bit_length() - 1, 0)
        self.gap = 0
        return out


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         end_id: int = 1, with_ids: bool = False, slice_bytes: int = 2 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the piece's ids (``array<int>``) on request. ``capacity`` must be a power of two.

    Every token lies in exactly one piece; a sequence's pieces lie gapless from offset 0; its
    filled length is ``capacity`` or, where a worker ends, a smaller power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        encode, packer = worker_encoder(tokenizer_path), Packer(TaskContext.get().partitionId() << 40, capacity)
        kinds = None

        def batch(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip((cols[0], *cols[1:5], *cols[6:]), kinds, strict=True)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4") for x in cols[5]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, [*names, *["ids"] * with_ids])

        for b in sliced(batches, text_col, slice_bytes):
            ids = b.column(b.schema.get_field_index(id_col))
            kinds = [ids.type, *[pa.int64()] * 6]
            texts = b.column(b.schema.get_field_index(text_col))
            done: list = []
            for doc, tokens in zip(ids.to_pylist(), encode(texts), strict=True):
                done += packer.add(doc, tokens + end)
            if done:
                yield batch(done)
        if last := packer.finish():
            yield batch(last)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {COLUMNS}" + ", ids array<int>" * with_ids)
