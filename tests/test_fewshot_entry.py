"""Few-shot draws (distinct, self excluded) and the driver contract on sf0.001."""

from pyspark.sql import functions as F

from feedlens.operators import fewshot as fs
from tests.conftest import SF


def test_random_picks_distinct_and_not_self(spark):
    pool = fs.with_pool_positions(spark.range(0, 7).withColumnRenamed("id", "row_id"))
    targets = spark.range(0, 20).withColumnRenamed("id", "row_id")
    picks = fs.random_picks(targets, pool, 3, mask_self=F.col("row_id") < 7).collect()
    pos = {r.row_id: r.pool_pos for r in pool.collect()}
    by = {}
    for r in picks:
        by.setdefault(r.row_id, []).append(r.pool_pos)
    assert len(by) == 20
    for t, ps in by.items():
        assert len(ps) == 3 and len(set(ps)) == 3 and all(0 <= p < 7 for p in ps)
        if t < 7:
            assert pos[t] not in ps


def test_pool_too_small(spark):
    pool = fs.with_pool_positions(spark.range(0, 2).withColumnRenamed("id", "row_id"))
    picks = fs.random_picks(pool.select("row_id"), pool, 2, mask_self=F.lit(True)).collect()
    assert all(len([p for p in picks if p.row_id == t]) == 1 for t in (0, 1))  # only one other row exists


def test_entry_and_registry(spark):
    import __spark_entry__ as se

    df = se.entry(spark)
    assert df.count() > 0 and "kappa" in df.columns
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 91


def test_some_queries_run_on_smallest_data(spark):
    import __spark_entry__ as se

    q = se.queries()
    for k in ("mcq_expand", "expanded_splits", "knn_self", "parse_binary", "preference_table", "classifier_report"):
        assert q[k](spark, SF).count() >= 0
