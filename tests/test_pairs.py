"""Mismatch pairing (group_sizes, permute_small) and score pairs (score_pairs)."""


from feedlens.operators import pairs as pa
from feedlens.plans import training as tr


def _src(spark, rows):
    return spark.createDataFrame(rows, "row_id LONG, qid LONG, feedback STRING")


def test_inner_group_sizes(spark):
    rows = [(1, 1, "a")] + [(i, 2, f"b{i}") for i in (2, 3)] + [(i, 3, f"c{i}") for i in (4, 5, 6)] + \
           [(i, 4, f"d{i}") for i in (7, 8, 9, 10)]
    out = pa.inner_neighbours(_src(spark, rows)).collect()
    by_q = {}
    for r in out:
        by_q.setdefault(r.qid, []).append(r)
    assert 1 not in by_q                       # a singleton has no neighbour
    assert len(by_q[2]) == 2 and len(by_q[3]) == 6 and len(by_q[4]) == 8
    for q, rs in by_q.items():
        assert all(r.alt_feedback != r.feedback for r in rs)  # distinct texts: never itself
        for shift in {r.shift for r in rs}:     # each shift is a permutation of the group's feedback
            assert sorted(r.alt_feedback for r in rs if r.shift == shift) == sorted(r.feedback for r in rs if r.shift == shift)


def test_outer_permutation_small(spark):
    for rows in ([(1, 1, "a")], [(1, 1, "a"), (2, 2, "b")]):
        out = pa.outer_permutation(_src(spark, rows)).collect()
        assert sorted(r.alt_feedback for r in out) == sorted(r[2] for r in rows)


def test_outer_permutation_bijection(spark):
    rows = [(i, i // 3, f"t{i}") for i in range(300)]
    out = pa.outer_permutation(_src(spark, rows), rounds=2).collect()
    for rnd in (0, 1):
        alts = [r.alt_feedback for r in out if r["round"] == rnd]
        assert sorted(alts) == sorted(r[2] for r in rows)


def test_outer_permutation_exclude_equal(spark):
    src = _src(spark, [(i, 1, f"t{i % 3}") for i in range(30)] + [(30, 1, None)])
    every = pa.outer_permutation(src).collect()
    got = pa.outer_permutation(src, exclude_equal=True).collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in every if r.feedback != r.alt_feedback)
    assert 0 < len(got) < len(every)


def test_score_pairs(spark):
    cols = "row_id LONG, qid LONG, question STRING, correct_answer STRING, explanation STRING, distractor STRING, " \
           "feedback STRING, incorrect DOUBLE, reveal DOUBLE, suggestions DOUBLE, misconceptions DOUBLE, positive DOUBLE"
    rows = [
        (1, 1, "q1", "c", "e", "d", "tie1", 0.0, 0.0, 1.0, 1.0, 1.0),
        (2, 1, "q1", "c", "e", "d", "tie2", 0.0, 0.0, 1.0, 1.0, 1.0),
        (3, 1, "q1", "c", "e", "d", "worse", 1.0, 0.0, 1.0, 1.0, 1.0),
        (4, 2, "q2", "c", "e", "d", "lone", 0.0, 0.0, 1.0, 1.0, 1.0),
        (5, 3, "q3", "c", "e", "d", "nulls", None, 0.0, 1.0, 1.0, 1.0),
        (6, 3, "q3", "c", "e", "d", "ok", 0.0, 0.0, 1.0, 1.0, 1.0),
        (7, 4, None, "c", "e", "d", "noq", 0.0, 0.0, 1.0, 1.0, 1.0),
        (8, 4, None, "c", "e", "d", "noq2", 1.0, 0.0, 1.0, 1.0, 1.0),
    ]
    out = tr.pref_scores(spark.createDataFrame(rows, cols)).collect()
    got = sorted((r.chosen, r.rejected) for r in out)
    assert got == [("tie1", "worse"), ("tie2", "worse")]


def _pairs_by_hand(rows):
    out = []
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[0] < b[0] and a[2] is not None and b[2] is not None and a[2] != b[2] and a[1] is not None:
                out.append((a[0], b[0], a[2], b[2]))
    return sorted(out)


def test_score_pairs_of_a_hot_item(spark):
    """An item of a third of all rows, ties and repeated scores, over blocks of a few rows."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"q{i % 40}", rng.choice([None, 0.0, 0.2, 0.2, 1.0, rng.random()])) for i in range(900)]
    rows += [(1000 + i, "tied", 0.5) for i in range(200)] + [(2000 + i, None, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id LONG, question STRING, score DOUBLE").withColumn("distractor", F.lit("d"))
    for block in (7, 64, 4096):
        out = pa.score_pairs(df, block_rows=block)
        assert out.columns == [*df.columns, *[f"b_{c}" for c in df.columns]]
        assert sorted((r.row_id, r.b_row_id, r.score, r.b_score) for r in out.collect()) == _pairs_by_hand(rows)


def test_score_pairs_spread_a_hot_item(spark):
    """No join key holds more than a pair of blocks; ties never meet."""
    from pyspark.sql import functions as F

    df = spark.range(3000).selectExpr("id AS row_id", "'q' AS question", "'d' AS distractor", "double(id % 2) AS score")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = pa.score_pairs(df, block_rows=100)
        per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per) == 1500 * 1500 and len(per) == 8 and max(per) < 0.3 * sum(per)
