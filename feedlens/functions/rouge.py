"""ROUGE-L F1 between two texts.

Tokenisation: lower-case, every run of characters outside ``[a-z0-9]`` is a separator. One
Arrow-batched ``pandas_udf`` receives the two whole texts, tokenises them with a compiled regex
and computes the longest common subsequence with the bit-parallel recurrence (one big-integer
operation per token of the second text), so texts of tens of thousands of words stay cheap.
Measured on sf0.1: shipping the two strings is cheaper than building token arrays in the JVM
(``split`` + ``filter`` runs interpreted) and shipping arrays of strings through Arrow.
Precision, recall and F1 are JVM expressions over the returned counts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def lcs_length(a, b) -> int:
    """LCS length of two token sequences (bit-parallel; equals the quadratic DP)."""
    m = len(a)
    if m == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << m) - 1
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return m - bin(v).count("1")


_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("lcs", "n_pred", "n_ref")])


@F.pandas_udf(_COUNTS)
def lcs_counts(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    lcs, n_p, n_r = [], [], []
    for x, y in zip(pred, ref):
        if x is None or y is None:
            lcs.append(None), n_p.append(None), n_r.append(None)
            continue
        tp = tokens(x)
        tr = tp if y == x else tokens(y)
        # a text against itself (e.g. the reference row of its own item): the LCS is the whole text
        lcs.append(len(tp) if tr is tp else lcs_length(tp, tr)), n_p.append(len(tp)), n_r.append(len(tr))
    return pd.DataFrame({"lcs": lcs, "n_pred": n_p, "n_ref": n_r}, dtype="Int64")


def rouge_l(pred, ref) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of ROUGE-L with ``pred`` as prediction and ``ref`` as reference."""
    c = lcs_counts(pred, ref)
    lcs = c["lcs"].cast("double")
    p = F.coalesce(F.try_divide(lcs, c["n_pred"].cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(lcs, c["n_ref"].cast("double")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return p, r, f


# ---- SQL counterpart for checks ----
# A table of all (i, j) is cubic in SQL. The match points (i, j) of equal tokens, by rising i and
# falling j, turn a common subsequence into a strictly rising run of j, so the LCS is the length of
# the longest one: a fold that keeps, for every length, the least j that ends a run of it. Its cost
# is (match points) x (LCS), near linear where words repeat little. The checks can also name a
# scalar function instead, an independent quadratic DP registered in DuckDB.

def sql_tokens(e: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g')), ' '), "
            f"lambda t: t <> '')")


def sql_lcs_rows(lcs_fn: str | None = None) -> str:
    """CTE ``rg_dp`` (rid, lcs) over ``rg_tok`` (rid, ta, tb)."""
    if lcs_fn:
        return f"rg_dp AS (SELECT rid, {lcs_fn}(ta, tb) AS lcs FROM rg_tok)"
    shorter = "len(list_filter(t, lambda v: v < e[1]))"
    return f"""rg_a AS (SELECT rid, unnest(ta) AS w, unnest(range(1, len(ta) + 1)) AS i FROM rg_tok WHERE ta <> tb),
rg_b AS (SELECT rid, unnest(tb) AS w, unnest(range(1, len(tb) + 1)) AS j FROM rg_tok WHERE ta <> tb),
rg_pts AS (SELECT a.rid, list([j] ORDER BY i, j DESC) AS pts FROM rg_a a JOIN rg_b b ON a.rid = b.rid AND a.w = b.w GROUP BY a.rid),
rg_run AS (SELECT rid, len(list_reduce(pts, lambda t, e: t[1:{shorter}] || e || t[{shorter} + 2:])) AS lcs FROM rg_pts),
rg_dp AS (SELECT t.rid, CASE WHEN ta = tb THEN len(ta) ELSE coalesce(lcs, 0) END AS lcs FROM rg_tok t LEFT JOIN rg_run r ON r.rid = t.rid)"""


def sql_rouge_ctes(src: str, id_col: str, pred: str, ref: str) -> str:
    """CTEs ``rg_tok``, ``rg_dp``, ``rouge`` and ``rouge_f`` (rid, rouge_p, rouge_r, rouge_f) over ``src``."""
    return f"""
rg_tok AS (SELECT {id_col} AS rid, {sql_tokens(pred)} AS ta, {sql_tokens(ref)} AS tb FROM {src}),
{sql_lcs_rows()},
rouge AS (
  SELECT t.rid, CASE WHEN len(t.ta) = 0 THEN 0.0 ELSE d.lcs / len(t.ta) END AS rouge_p,
    CASE WHEN len(t.tb) = 0 THEN 0.0 ELSE d.lcs / len(t.tb) END AS rouge_r
  FROM rg_tok t JOIN rg_dp d ON t.rid = d.rid),
rouge_f AS (
  SELECT rid, rouge_p, rouge_r, CASE WHEN rouge_p + rouge_r = 0 THEN 0.0
    ELSE 2 * rouge_p * rouge_r / (rouge_p + rouge_r) END AS rouge_f FROM rouge)"""
