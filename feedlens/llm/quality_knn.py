"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Fit (bounded): ``max_rows`` labelled documents, those with the smallest seeded hash of their id,
are the only fitted data. Their byte n-grams are hashed into ``dims`` counts; log counts times
inverse document frequency, scaled to length one, and the share of words that repeat the word
before them (which n-gram counts of long texts cannot show) go through a randomised singular
value decomposition to ``rank`` latent dimensions. What is broadcast is the projection (dims x rank)
and the labelled vectors (max_rows x rank): a fixed size, about 2 MB with the defaults,
whatever the corpus holds.

Score: every whole text is projected the same way; the cosines with all labelled vectors are
exact products in blocks of documents, and the ``k`` nearest vote with their labels, weighted by
a power of their similarity and smoothed with the sample's label mean. Nothing is shuffled.

Labels, language, source and ids are never inputs of a score.

Defined cases: a null or empty text has a zero vector, no similar neighbour, and so the label
mean as its score; without any usable label the mean is 0.5. Rows of labels with a null id or
null label are ignored; repeated labels of one id count by their mean. Repeated documents are
scored each; of documents that repeat a labelled id the one with the smallest seeded text hash is
fitted. An empty table gives no rows. Columns ``score`` and ``predicted`` replace input columns of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.llm.words import sliced, text_buffers, word_hashes, word_spans
from feedlens.operators.index import sample_exact

_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def ngram_counts(data: np.ndarray, offsets: np.ndarray, dims: int, sizes=(1, 2, 3)) -> np.ndarray:
    """(texts, dims) counts of hashed byte n-grams; none crosses a text's border."""
    n = len(offsets) - 1
    out = np.zeros(n * dims, np.float32)
    if not len(data):
        return out.reshape(n, dims)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    shift = np.uint32(32 - (dims - 1).bit_length())
    code = np.zeros(len(data), np.uint32)
    for size in range(1, max(sizes) + 1):
        code = code[:len(data) - size + 1] * np.uint32(257) + data[size - 1:].astype(np.uint32) + np.uint32(1)
        if size in sizes:
            inside = left[:len(code)] >= size
            at = ((code * _MUL[size % 3] + np.uint32(size)) * _MUL[(size + 1) % 3] >> shift).astype(np.int64)
            out += np.bincount(owner[:len(code)][inside] * dims + at[inside], minlength=n * dims)
    return out.reshape(n, dims)


def repeat_share(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the share of its words that equal the word before: stuttering text, which counts of
    n-grams, blind to how often a word follows itself, place beside ordinary text of its words."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    same = np.zeros(len(h) + 1, np.int64)
    same[1:len(h)] = h[1:] == h[:-1]
    same[first[:-1]] = 0  # a text's first word has none before it
    count = np.diff(first)
    total = np.r_[0, np.cumsum(same)]
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)


def features(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """(texts, dims + 1): n-gram counts and the repeat share in thousandths."""
    share = np.round(1000 * repeat_share(data, offsets)).astype(np.float32)
    return np.concatenate([ngram_counts(data, offsets, dims), share[:, None]], axis=1)


@dataclass
class LatentVotes:
    """The fitted space and the labelled vectors."""

    weights: np.ndarray  # (dims,) inverse document frequencies
    projection: np.ndarray  # (dims + 1, rank)
    vectors: np.ndarray  # (rows, rank), length one
    labels: np.ndarray  # (rows,)
    prior: float
    k: int
    power: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = _scaled(counts, self.weights) @ self.projection
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-6)

    def score(self, vectors: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(vectors), self.prior, np.float64)
        if not len(self.vectors):
            return out
        k = min(self.k, len(self.vectors))
        for s in range(0, len(vectors), block):
            cosine = vectors[s:s + block] @ self.vectors.T
            near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power
            total = vote.sum(1)
            out[s:s + block] = ((vote * self.labels[near]).sum(1) + 0.05 * self.prior) / (total + 0.05)
        return np.clip(out, 0.0, 1.0)


def _scaled(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.log1p(counts[:, :-1]) * weights
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return np.concatenate([x, counts[:, -1:] / np.float32(1000)], axis=1)


def fit_votes(counts: np.ndarray, labels: np.ndarray, rank: int, k: int, power: float, seed: int) -> LatentVotes:
    dims = counts.shape[1]  # hashed n-grams and the repeat share
    prior = float(labels.mean()) if len(labels) else 0.5
    weights = np.log((1.0 + len(counts)) / (1.0 + (counts[:, :-1] > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = _scaled(counts, weights)
    rank = max(1, min(rank, dims, len(x) or 1))
    # randomised SVD: a random range finder with three power steps
    basis = x.T @ (x @ np.random.default_rng(seed).standard_normal((dims, min(dims, rank + 16)), np.float32))
    for _ in range(3):
        basis = x.T @ (x @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    model = LatentVotes(weights, np.ascontiguousarray((basis @ vt[:rank].T).astype(np.float32)), np.zeros((0, rank), np.float32),
                        labels.astype(np.float64), prior, k, power)
    model.vectors = model.project(counts)
    return model


def _count_batches(text_col: str, dims: int):
    def run(batches):
        for b in sliced(batches, text_col, 1 << 20):
            at = b.schema.get_field_index(text_col)
            label = b.column(b.schema.get_field_index("label"))
            counts = features(*text_buffers(b.column(at)), dims)
            yield pa.RecordBatch.from_arrays([label, pa.array([r.astype("<f4").tobytes() for r in counts], pa.binary())],
                                             ["label", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = 4096, dims: int = 2048, rank: int = 64, k: int = 16, power: float = 8.0, seed: int = 42) -> LatentVotes:
    """Fits on at most ``max_rows`` labelled rows; only their hashed counts (8 KB each) reach the driver."""
    usable = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
              .agg(F.avg(F.col(label_col).cast("double")).alias("label")))
    # the smallest seeded hashes; 16**3 prefix counts settle which rows the last sort has to see
    sample = sample_exact(usable, max_rows, ["_id"], seed=seed, digits=3)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    # one text per id, whatever the order of arrival: first the hash alone, then one of the equal texts
    h = F.xxhash64(F.lit(seed), "_text")
    least = chosen.groupBy("_id").agg(F.min(h).alias("_h"))
    chosen = (chosen.withColumn("_h", h).join(F.broadcast(least), ["_id", "_h"]).groupBy("_id")
              .agg(F.first("label").alias("label"), F.min("_text").alias("_text")).drop("_id"))
    rows = chosen.mapInArrow(_count_batches("_text", dims), "label double, counts binary").toArrow()
    # by label and counts, so the order of arrival does not matter: rows equal in both are the same row
    pairs = sorted(zip(rows.column("label").to_pylist(), rows.column("counts").to_pylist(), strict=True))
    counts = np.frombuffer(b"".join(c for _, c in pairs), "<f4").reshape(-1, dims + 1)
    return fit_votes(counts, np.array([y for y, _ in pairs]), rank, k, power, seed)


def classify(docs: DataFrame, model: LatentVotes, text_col: str = "text", threshold: float = 0.7,
             slice_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold)."""
    names = {"score", "predicted"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dims = len(model.weights)

    def run(batches):
        m = shared.value
        for b in sliced(batches, text_col, slice_bytes):
            at = b.schema.get_field_index(text_col)
            data, offsets = text_buffers(b.column(at))
            score = np.concatenate([m.score(m.project(features(
                data[offsets[s]:offsets[min(s + 512, len(offsets) - 1)]], offsets[s:s + 513] - offsets[s], dims)))
                for s in range(0, len(offsets) - 1, 512)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                                              T.StructField("predicted", T.IntegerType())]))
