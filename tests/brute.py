"""Brute-force helpers for checks that SQL cannot do on whole texts.

``lcs_dp`` is the textbook quadratic LCS table, one numpy row per token of the first text:
``L[i][k] = max(L[i-1][k], L[i][k-1], L[i-1][k-1] + 1 if a_i == b_k)``. Because the previous row
is non-decreasing, the ``L[i][k-1]`` term is a running maximum, so each row is vectorised.
It shares no code with the bit-parallel recurrence used in Spark.
"""

from __future__ import annotations

import numpy as np


def lcs_dp(a, b) -> int:
    if not a or not b:
        return 0
    vocab: dict = {}
    bi = np.array([vocab.setdefault(t, len(vocab)) for t in b], dtype=np.int64)
    prev = np.zeros(len(b) + 1, dtype=np.int64)
    for tok in a:
        tid = vocab.get(tok, -1)
        cand = prev[1:].copy()
        if tid >= 0:
            hit = bi == tid
            cand[hit] = np.maximum(cand[hit], prev[:-1][hit] + 1)
        cur = np.empty_like(prev)
        cur[0] = 0
        np.maximum.accumulate(cand, out=cur[1:])
        prev = cur
    return int(prev[-1])


def register_duckdb(con) -> None:
    """Make ``lcs_dp(VARCHAR[], VARCHAR[]) -> BIGINT`` callable from DuckDB SQL."""
    con.create_function("lcs_dp", lcs_dp, ["VARCHAR[]", "VARCHAR[]"], "BIGINT")
