"""Text helpers (strip_hand, rouge_hand, feedback extraction)."""

from pyspark.sql import functions as F

from feedlens.functions import text as tx
from feedlens.functions.rouge import lcs_length, rouge_l


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "x STRING").select(col.alias("y")).first().y


def test_strip_matches_python(spark):
    samples = ["\n\tabc  ", " x y　", "  ", "", "a\x1cb\x1f"]
    df = spark.createDataFrame([(s,) for s in samples], "x STRING")
    got = [r.y for r in df.select(tx.strip("x").alias("y")).collect()]
    assert got == [s.strip() for s in samples]
    got = [r.y for r in df.select(tx.clean_whitespace("x").alias("y")).collect()]
    import re
    assert got == [re.sub(r"\s+", " ", s.strip()) for s in samples]


def test_extract_feedback(spark):
    import re

    def py(s):
        m = re.search(r"Feedback: (.*)$", s)
        return m.group(1).strip() if m else None

    samples = ["reason\nFeedback: good job ", "Feedback: a\nFeedback: b", "x Feedback: y\n", "Feedback: y\n\n",
               "none", "Feedback: x\r\n", "Feedback:\tno"]
    df = spark.createDataFrame([(s,) for s in samples], "x STRING")
    got = [r.y for r in df.select(tx.extract_feedback("x").alias("y")).collect()]
    assert got == [py(s) for s in samples]


def test_first_line_and_stop(spark):
    assert _one(spark, tx.first_line("x"), " a b \nc") == "a b"
    assert _one(spark, tx.until_blank_line("x"), "a\nb\n\nc") == "a\nb"


def test_lcs_bit_parallel_equals_dp():
    import random

    def dp(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        assert lcs_length(a, b) == dp(a, b)


def test_rouge_hand(spark):
    rows = [("a b c d", "a b c d"), ("a b", "c d"), ("a b c d", "a c d"), ("", "a"), ("café au", "caf au")]
    df = spark.createDataFrame(rows, "p STRING, r STRING")
    p, r, f = rouge_l(F.col("p"), F.col("r"))
    got = df.select(p.alias("p"), r.alias("r"), f.alias("f")).collect()
    assert got[0].f == 1.0
    assert got[1].f == 0.0
    assert (got[2].p, got[2].r, round(got[2].f, 4)) == (0.75, 1.0, 0.8571)
    assert got[3].f == 0.0
    assert got[4].f == 1.0  # accented letters separate tokens: "caf", "au" on both sides
