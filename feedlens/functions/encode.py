"""Sentence-encoder plug-in: any batch function ``fn(texts: list[str], dim) -> ndarray (n, dim)``
wrapped as an Arrow-batched ``pandas_udf`` returning unit vectors (``ARRAY<DOUBLE>``).

``hashed_bow`` is the deterministic stand-in used in tests and the registered query: a hashed
bag of lower-case ``[a-z0-9]`` words, L2-normalised.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[a-z0-9]+")


def hashed_bow(texts, dim: int) -> np.ndarray:
    out = np.zeros((len(texts), dim), dtype=np.float64)
    for i, t in enumerate(texts):
        for w in _WORD.findall((t or "").lower()):
            out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def encoder_udf(fn, dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(texts: pd.Series) -> pd.Series:
        vecs = fn(texts.fillna("").tolist(), dim)
        return pd.Series([v.tolist() for v in vecs])

    return encode
