"""BERTScore on word vectors against a plain double loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.functions.bertscore import bertscore, hashed_words, match_means


def _brute(a, b):
    if not a or not b:
        return 0, 0
    vec = {w: hashed_words([w])[0] for w in {*a, *b}}
    sim = lambda x, y: int(np.floor(np.dot(vec[x], vec[y]) / (np.sqrt(vec[x] @ vec[x]) * np.sqrt(vec[y] @ vec[y])) * 1e6 + 0.5))
    mean = lambda xs: (2 * sum(xs) + len(xs)) // (2 * len(xs))
    return mean([max(sim(x, y) for y in b) for x in a]), mean([max(sim(x, y) for x in a) for y in b])


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_match_means_equals_brute_force(block):
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = ([f"w{i}" for i in rng.integers(0, 12, rng.integers(0, 15))] for _ in range(2))
        assert match_means(a, b, hashed_words, block) == _brute(a, b)


def test_zero_vectors_match_nothing():
    assert match_means(["a"], ["b"], lambda ws: np.zeros((len(ws), 4))) == (0, 0)


def test_bertscore_column(spark):
    rows = [(1, "one two two", "Two one, two"), (2, None, "x"), (3, "x", None), (4, "", "x"), (5, "...", ""), (6, "a b", "c d e")]
    df = spark.createDataFrame(rows, "id long, p string, r string")
    got = {r.id: tuple(r)[1:] for r in df.select("id", *bertscore(F.col("p"), F.col("r"))).collect()}
    assert got[1] == (1.0, 1.0, 1.0) and got[2] == got[3] == (None, None, None) and got[4] == got[5] == (0.0, 0.0, 0.0)
    p, r = (x / 1e6 for x in _brute(["a", "b"], ["c", "d", "e"]))
    assert got[6] == (p, r, 2 * p * r / (p + r))
