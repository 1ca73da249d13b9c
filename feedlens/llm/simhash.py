"""SimHash near duplicates by pigeonhole blocks.

Method: every text gets a 64-bit SimHash over its 3-word shingles (XXH64, seed 42). Fingerprints
are cut into five blocks of bits. Two fingerprints that differ in at most three bits agree on
at least two blocks, so they meet under one of ten (block, block) keys; the Hamming distance of
all fingerprints that meet is then verified, and linked fingerprints form components.

Skew. Equal fingerprints collapse to one node first (pre-aggregated, so thousands of copies are
one row). Keys shared by more than ``group_limit`` different fingerprints are never collected:
their remaining bits are cut into ``max_bits + 1`` parts, of which a close pair must agree on at
least one, so the group splits exactly into smaller ones, again and again. A group whose free
bits number log2(group_limit) cannot be larger than the limit, so this ends. A group emits at
most a spanning forest of its links, never its pairs.

Defined cases: a null or empty text has no shingle and fingerprint zero, linked like any other;
fewer words than a shingle: the whole sequence is the one shingle. A null doc_id stays null and
never names a component unless no other id is in it. Repeated rows are returned as often as
they occur. An empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.components import connected_components
from feedlens.llm.words import text_buffers
from feedlens.sources.files import materialize

BITS = 64


def _bit_votes(digests: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints from shingle hashes; text i owns digests[first[i]:first[i + 1]]."""
    out = np.zeros(len(first) - 1, np.uint64)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if len(full):
        # byte-wise votes: unpack the bits of a bounded run of shingles at a time
        votes = np.zeros((len(full), BITS), np.int64)
        run = 1 << 18
        owner = np.repeat(np.arange(len(full)), counts[full])
        for at in range(0, len(digests), run):
            bits = np.unpackbits(digests[at:at + run].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[at:at + run]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            votes[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        over = 2 * votes > counts[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: lower-case A-Z, words joined by one space, shingle repeats counted."""
    import xxhash

    data, offsets = text_buffers(texts)
    data, digest = data.tobytes(), xxhash.xxh64_intdigest
    digests: list[int] = []
    first = np.zeros(len(offsets), np.int64)
    parts: list[np.ndarray] = []
    out = np.zeros(len(offsets) - 1, np.uint64)
    held, base = 0, 0

    def flush(upto: int) -> None:
        nonlocal digests, base
        out[base:upto] = _bit_votes(np.array(digests, dtype=np.uint64), first[base:upto + 1] - first[base])
        digests, base = [], upto

    for i in range(len(offsets) - 1):
        words = data[offsets[i]:offsets[i + 1]].lower().split()
        if words:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.r_[0, ends[:-1] + 1]
            k = min(shingle, len(words))
            digests += [digest(joined[s:e], seed) for s, e in
                        zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)]
        first[i + 1] = first[base] + len(digests)
        if len(digests) > 1 << 19:
            flush(i + 1)
    flush(len(offsets) - 1)
    return out


def _fingerprint_batches(id_col: str, text_col: str, shingle: int, seed: int, slice_bytes: int):
    from feedlens.llm.words import sliced

    def run(batches):
        for b in sliced(batches, text_col, slice_bytes):
            ids = b.column(b.schema.get_field_index(id_col))
            fp = fingerprints(b.column(b.schema.get_field_index(text_col)), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp)], ["doc_id", "fp"])

    return run


def block_masks(blocks: int = 5, keep: int = 2) -> list[int]:
    """Bit masks of all ``keep``-subsets of ``blocks`` nearly equal runs of the 64 bits."""
    runs = [int(sum(1 << int(b) for b in part)) for part in np.array_split(np.arange(BITS), blocks)]
    return [sum(c) for c in combinations(runs, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _finer(mask: int, parts: int) -> list[int]:
    """``mask`` plus each of ``parts`` runs of its free bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(np.array(free), parts) if len(part)]


def _links(max_bits: int):
    """Arrow batches of groups -> links (a < b as unsigned) that span each group's close pairs."""

    def small(groups: np.ndarray):
        i, j = np.triu_indices(groups.shape[1], 1)
        left, right = groups[:, i].ravel(), groups[:, j].ravel()
        near = np.bitwise_count(left ^ right) <= max_bits
        return left[near], right[near]

    def large(group: np.ndarray):
        rest, a, b = group, [], []
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                near = np.bitwise_count(rest ^ x) <= max_bits
                found, rest = rest[near], rest[~near]
                a += [x] * len(found)
                b += found.tolist()
                todo += found.tolist()
        return np.array(a, np.uint64), np.array(b, np.uint64)

    def run(batches):
        for batch in batches:
            col = batch.column(0)
            sizes = np.diff(col.offsets.to_numpy())
            values = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
            for size in np.unique(sizes):
                at = starts[sizes == size]
                if size < 2:
                    continue
                if size <= 12:
                    found = [small(values[at[:, None] + np.arange(size)])]
                else:
                    found = (large(values[s:s + size]) for s in at)
                for x, y in found:
                    if len(x):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def hamming_links(nodes: DataFrame, max_bits: int = 3, blocks: int = 5, group_limit: int = 4096) -> DataFrame:
    """Links (a, b) that join every pair of fingerprints (column ``fp``, distinct) at ``max_bits``
    or fewer differing bits, directly or through other links of the same group."""
    spark = nodes.sparkSession
    masks = block_masks(blocks, blocks - max_bits)
    at = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
    rows = nodes.select("fp", F.explode(F.array(*[at(m) for m in masks])).alias("k")).select("fp", "k.mask", "k.key")
    found = None
    while True:
        sizes = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
        cold = (rows.join(sizes.filter(F.col("n") <= group_limit).drop("n"), ["mask", "key"])
                .groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")))
        links = materialize(cold.select("fps").mapInArrow(_links(max_bits), "a long, b long").distinct(), "simhash-links")
        found = links if found is None else found.unionByName(links)
        hot = sizes.filter(F.col("n") > group_limit)
        if hot.isEmpty():
            return found.distinct()
        # at most 10 * 4**level masks: a constant of the method, not of the data
        finer = {m: _finer(m, max_bits + 1) for m in masks}
        table = spark.createDataFrame([(_signed(m), _signed(f)) for m, fs in finer.items() for f in fs],
                                      "mask long, finer long")
        masks = sorted({f for fs in finer.values() for f in fs})
        rows = materialize(rows.join(hot.drop("n"), ["mask", "key"]).join(F.broadcast(table), "mask")
                           .select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"))
                           .distinct(), "simhash-finer")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 3, seed: int = 42, group_limit: int = 4096,
                       slice_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id
    reachable through links of ``max_bits`` or fewer differing bits)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fps = materialize(docs.select(id_col, text_col).mapInArrow(
        _fingerprint_batches(id_col, text_col, shingle, seed, slice_bytes), f"doc_id {kind}, fp long"), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(hamming_links(nodes, max_bits, max_bits + 2, group_limit))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = (member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root")
             .select("fp", "component_id"))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
