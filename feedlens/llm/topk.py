"""Exact top-k inner products by columnar branch-and-bound.

Method: candidate blocks are held in vertical layout (one row per dimension, dimensions ordered
by their share of the mass over all rows). Scores accumulate one block of dimensions at a time;
after each, a candidate whose partial score plus the most that its remaining dimensions can add
(Cauchy-Schwarz over the remaining mass of query and candidate) is below the query's running
k-th best score is dropped, and the survivors are compacted before the next dimensions.

Layout. Queries and candidates are dealt into blocks of bounded rows by a hash of their row
number; a task scores one query block against one candidate block and keeps k rows per query.
Only k rows per query and candidate block leave a task, and their final ranking is pre-cut
in the same tasks. No pair of rows is ever a Spark row before it is a top-k candidate of its
block, nothing is broadcast, and a block holds a fixed number of rows at any input size.

Exact sums: a block whose sums stay below 2**53 is scored in doubles, one below 2**63 in longs. In
any other block doubles only prune, with a bound on their own rounding, and what is left is
scored in integers of any length. Scores leave a task as two longs (high, low), so they rank
rightly far beyond a long; a result row whose score does not fit a long is an error, never a
wrapped number.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part;
neither do rows without an id. Components of any finite size count; floor(scale * x) is a whole
double. A shorter vector counts as padded with zeros. Candidates exclude rows with the query's
own id. Ties go to the smaller id; rows that repeat an id are ranked as rows of their
own. Fewer than k candidates: all of them. No query or candidate: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlens.sources.files import materialize

_LIMB = 1 << 62


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component as a whole double, of the rows that take part.
    ``scale`` is a power of two, so that the product is exact."""
    v = F.col(vec_col)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.forall(v, lambda x: x.isNotNull() & finite(x.cast("double")))
    # floor() gives a long, which large components leave; those are whole numbers already
    whole = lambda x: F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)
    return (df.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: whole(x.cast("double") * scale)).alias("v")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as a (rows, dims) matrix, shorter rows padded with zeros."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
    out = np.zeros((len(sizes), dims), np.float64)
    out[np.arange(dims) < sizes[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def search_block(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, step: int):
    """Row numbers (query, candidate) and scores, as Python integers, of each query's k best in
    one block. Columns of q and c, whole doubles, are in the order in which they are accumulated.
    """
    dims = c.shape[1]
    most = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(c).max(initial=0))) * max(1, dims)
    kind = np.int64 if 2 ** 53 <= most < 2 ** 63 else np.float64
    sure_sums = most < 2 ** 63
    order = np.argsort(c_id, kind="stable")  # ties: the smaller id comes first
    c, c_id = c[order], c_id[order]
    vertical, whole = np.ascontiguousarray(c.T.astype(kind)), q.astype(kind)
    cuts = list(range(0, dims, step)) or [0]
    with np.errstate(over="ignore", invalid="ignore"):
        # mass that remains from each cut on, one row per cut
        rest_c = np.sqrt(np.array([(c[:, s:] ** 2).sum(1) for s in cuts] + [np.zeros(len(c))]))
        rest_q = np.sqrt(np.array([(q[:, s:] ** 2).sum(1) for s in cuts] + [np.zeros(len(q))]))
        first = whole[:, :step] @ vertical[:step]
    prune = np.isfinite(rest_c).all() and np.isfinite(rest_q).all() and bool(np.isfinite(rest_q.max(initial=0) * rest_c.max(initial=0)))
    rounding = max(2.0 ** -40, dims * 2.0 ** -50)  # of bounds and of sums of doubles, as a part of the whole mass
    rows, cols, scores = [], [], []
    for i in range(len(q)):
        alive = np.flatnonzero(c_id != q_id[i])
        score = first[i][alive] if prune else None
        for b in range(1, len(cuts) + 1) if prune else ():
            if len(alive) > k:
                # k candidates reach at least this; whoever can't is out
                bound = rest_q[b, i] * rest_c[b][alive] + rounding * rest_q[0, i] * rest_c[0][alive]
                sure = score - bound
                keep = score + bound >= np.partition(sure, len(sure) - k)[len(sure) - k]
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            if b < len(cuts):
                score = score + whole[i, cuts[b]:cuts[b] + step] @ vertical[cuts[b]:cuts[b] + step, alive]
        if sure_sums:
            best = np.argsort(-score, kind="stable")[:k]
            found = [int(x) for x in score[best]]
        else:
            own = [int(x) for x in q[i]]
            exact = [sum(x * int(y) for x, y in zip(own, c[j], strict=True)) for j in alive]
            best = sorted(range(len(alive)), key=lambda j: -exact[j])[:k]
            found = [exact[j] for j in best]
        rows += [i] * len(best)
        cols += order[alive[best]].tolist()
        scores += found
    return np.array(rows, np.int64), np.array(cols, np.int64), scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, query_rows: int = 512, block_rows: int = 8192,
          step: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``queries`` against all ``vectors``.

    Both are (id long, v array<double> of whole numbers). ``query_rows`` and ``block_rows`` bound the blocks,
    ``step`` is the number of dimensions accumulated between two prunings.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    queries = materialize(queries.withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    n, m = vectors.count(), queries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not m:
        return empty
    # mass by dimension over all rows: as many rows as there are dimensions
    mass = (vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d")
            .agg(F.sum(F.col("x").cast("double") ** 2).alias("m")).collect())
    longest = queries.agg(F.max(F.size("v"))).first()[0]
    dims = max([longest, *(r.d + 1 for r in mass)], default=0)
    heavy = np.zeros(dims)
    for r in mass:
        heavy[r.d] = r.m
    order = np.argsort(-heavy, kind="stable")
    blocks, groups = -(-n // block_rows), -(-m // query_rows)
    part = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    left = (queries.withColumn("g", part(groups))
            .select("id", "row", "v", "g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")))
    right = (vectors.withColumn("b", part(blocks))
             .select("id", "row", "v", "b", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")))

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        qm, cm = _matrix(q.column("v"), dims)[:, order], _matrix(c.column("v"), dims)[:, order]
        q_id, c_id = q.column("id").to_numpy(), c.column("id").to_numpy()
        i, j, s = search_block(qm, q_id, cm, c_id, k, step)
        if any(abs(x) >= _LIMB << 62 for x in s):
            raise OverflowError("a score among the best of its block has over 124 bits")
        high = pa.array([x // _LIMB for x in s], pa.int64())  # floor, so that low is never negative
        return pa.table({"q": q.column("row").to_numpy()[i], "query_id": q_id[i], "vec_id": c_id[j], "high": high,
                         "low": pa.array([x % _LIMB for x in s], pa.int64())})

    found = (left.groupBy("g", "b").cogroup(right.groupBy("g", "b"))
             .applyInArrow(score, "q long, query_id long, vec_id long, high long, low long"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("high"), F.desc("low"), "vec_id")))
    # high * 2**62 + low, in steps that stay within a long
    fits = F.when(F.col("high").between(-2, 1), F.col("high") * F.lit(_LIMB // 2) + F.col("high") * F.lit(_LIMB // 2) + F.col("low"))
    score_of = fits.otherwise(F.raise_error(F.concat(F.lit("the score of query "), F.col("query_id"), F.lit(" and vector "), F.col("vec_id"),
                                                     F.lit(" leaves a long"))).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score_of.alias("score"))
