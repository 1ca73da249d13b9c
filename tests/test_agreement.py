"""Agreement metrics on hand-worked values (agreement_hand) and pairing of duplicates (dup_pairs)."""

import pytest
from pyspark.sql import functions as F

from feedlens.operators import agreement as ag


def _metrics(spark, a, b):
    rows = [("m", "l", float(x), float(y)) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "method STRING, label STRING, a DOUBLE, b DOUBLE")
    out = ag.agreement_metrics(df).filter("method = 'm'").first()
    return out


def test_agreement_hand(spark):
    r = _metrics(spark, [1, 0, 0, 0], [1, 1, 0, 0])  # prediction a, truth b
    assert r.accuracy == 0.75
    assert r.kappa == pytest.approx(0.5)
    assert r.precision == 1.0 and r.recall == 0.5
    assert r.f1 == pytest.approx(2 / 3)


def test_agreement_constant_columns(spark):
    r = _metrics(spark, [1, 1, 1, 1], [1, 0, 1, 0])
    assert r.pearson is None and r.kappa == pytest.approx(0.0)
    r = _metrics(spark, [1, 1, 1], [1, 1, 1])
    assert r.kappa is None and r.pearson is None and r.accuracy == 1.0
    r = _metrics(spark, [0, 0, 0], [1, 0, 1])
    assert r.precision == 0.0 and r.f1 == 0.0


def test_all_level_and_symmetry(spark):
    rows = [("x", "l", 1.0, 1.0), ("x", "l", 0.0, 1.0), ("y", "l", 0.0, 0.0), ("y", "l", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "method STRING, label STRING, a DOUBLE, b DOUBLE")
    got = {r.method: r for r in ag.agreement_metrics(df).collect()}
    assert set(got) == {"x", "y", "all"} and got["all"].n == 4
    sw = df.select("method", "label", F.col("b").alias("a"), F.col("a").alias("b"))
    got2 = {r.method: r for r in ag.agreement_metrics(sw).collect()}
    assert got["all"].kappa == pytest.approx(got2["all"].kappa)


def test_dup_pairs(spark):
    cols = "row_id LONG, qid LONG, question STRING, correct_answer STRING, explanation STRING, distractor STRING, " \
           "feedback STRING, method STRING, reveal DOUBLE"
    a = spark.createDataFrame([(1, 1, "q", "c", "e", "d", "f", "m", 1.0), (2, 1, "q", "c", "e", "d", "f", "m", 0.0),
                               (3, None, "q", "c", "e", None, "g", "m", 1.0), (4, 2, "q", "c", "e", "d", "x", "m", 1.0)], cols)
    b = spark.createDataFrame([(11, 1, "q", "c", "e", "d", "f", "m", 1.0), (12, 1, "q", "c", "e", "d", "f", "m", 1.0),
                               (13, 1, "q", "c", "e", "d", "f", "m", 0.0), (14, None, "q", "c", "e", None, "g", "m", 0.0),
                               (15, 2, "q", "c", "e", "d", "y", "m", 1.0)], cols)
    p = ag.pair_annotations(a, b, ["reveal"]).collect()
    pairs = sorted((r.row_id, r.row_id_b) for r in p)
    assert len(pairs) == 3                       # two of three duplicates paired 1:1, NULL keys match
    assert (3, 14) in pairs
    assert len({x for x, _ in pairs}) == 3 and len({y for _, y in pairs}) == 3


def test_kappa_counts_every_category(spark):
    from feedlens.operators import agreement as ag

    long = spark.createDataFrame([("m", "l", a, b) for a, b in ((4.0, 4.0), (4.0, 4.0), (0.0, 0.0), (1.0, 0.0))],
                                 "method string, label string, a double, b double")
    rows = {r.method: r for r in ag.agreement_metrics(long).collect()}
    assert set(rows) == {"m", "all"} and abs(rows["m"].kappa - 0.6) < 1e-12 and rows["m"].n == 4
