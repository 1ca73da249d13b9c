"""BERTScore of two texts from word vectors: greedy matching of every word of one text with its most
similar word (cosine) of the other; precision is the mean over the predicted words, recall the mean
over the reference's, F1 their harmonic mean.

One Arrow-batched ``pandas_udf`` receives the two whole texts. An encoder plug-in
``fn(words: list[str]) -> ndarray (n, dim)`` gives one vector per distinct word, so repeated words
count by their number and a pair costs (distinct words) x (distinct words) products. Both directions
come from the same product, taken in blocks of bounded size. Token vectors that depend on their
context go through the token-vector tables of ``operators.similarity`` instead.

Similarities and means are whole millionths, so that no result depends on the order of a sum.
A null text gives null; without words on either side precision and recall are 0.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.functions.rouge import sql_tokens, tokens

DIM = 16


def hashed_words(words: list[str]) -> np.ndarray:
    """Deterministic stand-in encoder: odd numbers from -15 to 15 out of the md5 of each word."""
    raw = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:DIM // 2] for w in words), np.uint8).reshape(-1, DIM // 2)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, DIM).astype(np.float64) * 2 - 15


def match_means(pred: list[str], ref: list[str], encode, block: int = 1024) -> tuple[int, int]:
    """(precision, recall) in millionths."""
    a, b = Counter(pred), Counter(ref)
    if not a or not b:
        return 0, 0
    if a == b:
        return 1_000_000, 1_000_000
    va, vb = encode(list(a)), encode(list(b))
    na, nb = np.sqrt((va * va).sum(1)), np.sqrt((vb * vb).sum(1))
    # a word of both texts is its own best match (cosine 1) unless its vector is zero: only words
    # without such a match meet the other text's words
    ca = np.fromiter((w in b for w in a), bool, len(a)) & (na > 0)
    cb = np.fromiter((w in a for w in b), bool, len(b)) & (nb > 0)
    best_a, best_b = np.where(ca, 1.0, -2.0), np.where(cb, 1.0, -2.0)

    def meet(ia: np.ndarray, ib: np.ndarray, for_a: bool, for_b: bool) -> None:
        for i in (ia[at:at + block] for at in range(0, len(ia), block)):
            for j in (ib[at:at + block] for at in range(0, len(ib), block)):
                length = na[i, None] * nb[None, j]
                s = va[i] @ vb[j].T
                s = np.divide(s, length, out=np.zeros_like(s), where=length > 0) if not length.all() else np.divide(s, length, out=s)
                if for_a:
                    best_a[i] = np.maximum(best_a[i], s.max(1))
                if for_b:
                    best_b[j] = np.maximum(best_b[j], s.max(0))

    new_a, new_b = np.flatnonzero(~ca), np.flatnonzero(~cb)
    meet(new_a, new_b, True, True)
    meet(new_a, np.flatnonzero(cb), True, False)
    meet(np.flatnonzero(ca), new_b, False, True)
    # rounding keeps the order, so the largest is rounded, not all
    best_a, best_b = (np.floor(x * 1_000_000 + 0.5).astype(np.int64) for x in (best_a, best_b))

    def mean(best: np.ndarray, counts: Counter) -> int:
        times = np.fromiter(counts.values(), np.int64)
        return int((2 * int((best * times).sum()) + int(times.sum())) // (2 * int(times.sum())))

    return mean(best_a, a), mean(best_b, b)


def bertscore(pred, ref, encode=hashed_words) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of BERTScore with ``pred`` as prediction and ``ref`` as reference."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("p", "r")]))
    def means(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if u is None or v is None else match_means(tokens(u), tokens(v), encode)
                for u, v in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["p", "r"], dtype="Int64")

    m = means(pred, ref)
    p, r = m["p"] / F.lit(1000000.0), m["r"] / F.lit(1000000.0)
    return p, r, F.when(p.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


# ---- SQL counterpart with the stand-in encoder ----

def sql_bertscore_ctes(src: str, id_col: str, pred: str, ref: str) -> str:
    """CTEs ending in ``bert_f`` (rid, bert_p, bert_r, bert_f) over the rows of ``src`` with words on both sides."""
    words = lambda e: f"SELECT rid, w, count(*) AS c FROM (SELECT {id_col} AS rid, unnest({sql_tokens(e)}) AS w FROM {src}) GROUP BY ALL"
    vec = f"list_transform(range(1, {DIM + 1}), lambda i: CAST(2 * ('0x' || substr(md5(w), i, 1))::INTEGER - 15 AS DOUBLE))"
    sim = "CAST(floor(list_dot_product(p.v, r.v) / (p.n * r.n) * 1000000 + 0.5) AS BIGINT)"
    mean = "CAST(floor((2.0 * sum(m * c) + sum(c)) / (2.0 * sum(c))) AS DOUBLE) / 1000000.0"
    side = lambda s: (f"SELECT rid, {mean} AS x FROM (SELECT p.rid, {s}.w, any_value({s}.c) AS c, max({sim}) AS m "  # noqa: E731
                      f"FROM bs_p p JOIN bs_r r ON p.rid = r.rid GROUP BY p.rid, {s}.w) GROUP BY rid")
    return f"""
bs_wp AS MATERIALIZED ({words(pred)}),
bs_wr AS MATERIALIZED ({words(ref)}),
bs_v AS MATERIALIZED (SELECT w, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT w, {vec} AS v FROM (SELECT w FROM bs_wp UNION SELECT w FROM bs_wr))),
bs_p AS MATERIALIZED (SELECT rid, w, c, v, n FROM bs_wp JOIN bs_v USING (w)),
bs_r AS MATERIALIZED (SELECT rid, w, c, v, n FROM bs_wr JOIN bs_v USING (w)),
bert AS (SELECT a.rid, a.x AS bert_p, b.x AS bert_r FROM ({side('p')}) a JOIN ({side('r')}) b ON a.rid = b.rid),
bert_f AS (SELECT *, CASE WHEN bert_p + bert_r = 0 THEN 0.0 ELSE 2 * bert_p * bert_r / (bert_p + bert_r) END AS bert_f FROM bert)"""
