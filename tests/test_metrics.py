"""ROC AUC (auc_hand), rounding (round_hand), ensemble and loss."""

import math

import pytest
from pyspark.sql import functions as F

from feedlens.operators import metrics as mt


def _auc(spark, y, s, **kw):
    df = spark.createDataFrame([("g", 0, float(a), float(b)) for a, b in zip(s, y)], "grp STRING, label INT, x DOUBLE, y DOUBLE")
    return mt.roc_auc(df, **kw).first().auc


def test_auc_hand(spark):
    assert _auc(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]) == pytest.approx(0.75)
    assert _auc(spark, [0, 0, 1, 1], [0.5, 0.5, 0.5, 0.5]) == pytest.approx(0.5)
    assert _auc(spark, [1, 1, 1], [0.1, 0.2, 0.3]) is None


def test_auc_buckets_equal_brute_force(spark):
    import random
    rnd = random.Random(3)
    y = [rnd.randint(0, 1) for _ in range(400)]
    s = [round(rnd.random(), 2) for _ in range(400)]  # many ties
    pos = [a for a, t in zip(s, y) if t == 1]
    neg = [a for a, t in zip(s, y) if t == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert _auc(spark, y, s, buckets=8) == pytest.approx(brute)


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x DOUBLE")
    assert [r.y for r in df.select(F.bround("x", 0).alias("y")).collect()] == [0.0, 2.0, 2.0]


def test_ensemble_probabilities_and_bce(spark):
    df = spark.createDataFrame([("a", 1, [0.0, 2.0, -2.0, 0.0, 0.0], [1.0, 0.0, 0.0, 1.0, 1.0], "gold"),
                                ("b", 1, [2.0, 0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 1.0, 1.0], "gold")],
                               "model STRING, row_id INT, logits ARRAY<DOUBLE>, truth ARRAY<DOUBLE>, method STRING")
    e = mt.ensemble(df).first()
    assert list(e.logits) == [1.0, 1.0, -1.0, 0.0, 0.0]
    p = spark.createDataFrame([(e.logits,)], "l ARRAY<DOUBLE>").select(mt.probabilities(F.col("l")).alias("p")).first().p
    sig = lambda x: 1 / (1 + math.exp(-x))
    assert p[0] == pytest.approx(1 - sig(1.0)) and p[2] == pytest.approx(sig(-1.0))
    x, y = 1.0, 1.0
    t = spark.createDataFrame([(x, y)], "x DOUBLE, y DOUBLE").select(mt.bce_terms(F.col("x"), F.col("y")).alias("t")).first().t
    assert t == pytest.approx(-math.log(sig(1.0)))
