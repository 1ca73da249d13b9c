"""Physical-plan properties that matter at scale."""

import pytest

from pyspark.sql import functions as F

from feedlens.operators import index as ix
from feedlens.operators.similarity import block_topk
from feedlens.sources import files as fl
from feedlens.session import shared_dir
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    """Physical plan with exchanges (the initial adaptive plan)."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_seeded_order_has_no_single_partition_on_big_side(spark):
    df = spark.range(0, 20000)
    p = _optimized(ix.seeded_order(df, ["id"]))
    assert "hashpartitioning(_bucket" in p          # rows spread by hash bucket
    assert p.count("SinglePartition") <= 1          # only the bucket-offset table (<= 65,536 rows)
    assert "BroadcastExchange" in p or "BroadcastHashJoin" in p


def test_ordered_index_numbers_rows_in_their_partitions(spark):
    p = _optimized(ix.ordered_index(spark.range(0, 1000), ["id"]))
    assert p.count("SinglePartition") <= 1          # only the per-partition offsets
    assert p.count("Window") <= 2 and "BroadcastHashJoin" in p


@pytest.mark.parametrize("key", ["row_index", "batch_ids", "sorted_annotations", "rm_mismatch_outer", "pref_mismatch_outer",
                                 "rm_training_table", "preference_table", "sft_loss_mask"])
def test_positions_move_no_rows_to_one_task(spark, key):
    """A single-partition exchange may only hold counts (a row per partition or hash bucket)."""
    from feedlens.catalog import QUERIES

    p = _optimized(QUERIES[key](spark, SF))
    for part in p.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in part[:400], part[:400]


def test_topk_uses_window_group_limit(spark):
    t = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "target_id LONG, vec ARRAY<DOUBLE>")
    p = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "pool_id LONG, vec ARRAY<DOUBLE>")
    plan = _optimized(block_topk(t, p, left_id="target_id", right_id="pool_id", k=2))
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sample_exact_is_take_ordered(spark):
    plan = _optimized(ix.sample_exact(spark.range(0, 1000), 10, ["id"]))
    assert "TakeOrderedAndProject" in plan


def test_partition_pruning_on_split(spark):
    df = spark.range(0, 100).select("id", F.when(F.col("id") % 3 == 0, "train").otherwise("val").alias("split"))
    path = shared_dir(spark, "pruning") + "/t"
    fl.write_table(df, path, partition_by=["split"])
    q = fl.select_partition(fl.read_table(spark, path), split="val")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan and "= val)" in plan
    assert q.count() == 66


def test_sample_exact_filters_before_top_n(spark):
    # only rows at or below the hash-prefix cut (a scalar subquery) reach the final top-n
    plan = _optimized(ix.sample_exact(spark.range(0, 5000), 10, ["id"]))
    top = plan[plan.index("TakeOrderedAndProject"):]
    assert "Subquery" in top and "Filter" in top and "_sb" in top


def test_pairing_never_shuffles_on_text(spark):
    from feedlens.operators.agreement import pair_annotations
    rows = [(i, i // 3, "d", "long text " * 50 + str(i % 7), 1.0) for i in range(60)]
    a = spark.createDataFrame(rows, "row_id LONG, qid LONG, distractor STRING, feedback STRING, reveal DOUBLE")
    out = pair_annotations(a, a, ["reveal"], item_cols=("row_id", "qid", "distractor", "feedback"))
    plan = _optimized(out)
    parts = [line for line in plan.split("\n") if "hashpartitioning(" in line]
    assert parts and not any("feedback" in line for line in parts)
    assert out.count() == 60


def test_cache_lookup_joins_on_digest(spark):
    from feedlens.sources import cache as cc
    k = dict(model="m", max_tokens=10, system_message=None)
    prompts = cc.with_key(spark.createDataFrame([(i, "p" * 300 + str(i)) for i in range(50)], "row_id LONG, prompt STRING"), **k)
    stored = cc.with_key(spark.createDataFrame([("p" * 300 + "1", "r1")], "prompt STRING, response STRING"), **k)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffle join a large cache gets
    try:
        out = cc.lookup(prompts, stored)
        parts = [line for line in _optimized(out).split("\n") if "hashpartitioning(" in line]
        # both sides hash the digest (the cache side under its join alias), never the prompt
        assert parts and all(("key_hash" in line or "_c_h" in line) and "prompt" not in line for line in parts)
        assert {r.row_id for r in out.filter("response IS NOT NULL").collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_roc_auc_running_counts_inside_buckets(spark):
    from feedlens.operators.metrics import roc_auc
    rows = [(g, 0, float(i % 97), float(i % 2)) for g in ("a", "b") for i in range(400)]
    long = spark.createDataFrame(rows, "grp STRING, label INT, x DOUBLE, y DOUBLE")
    plan = _optimized(roc_auc(long))
    running = [line for line in plan.split("\n") if "Window [" in line and "x#" in line.split("Window [", 1)[1]]
    assert running and all("_bk" in line for line in running)  # never one window over a whole label
