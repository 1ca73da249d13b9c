"""Plan properties of every registered query (sf0.001): no cross products or nested-loop joins,
and Python runs only Arrow-batched (no row-at-a-time UDF operator)."""

import pytest

from feedlens.catalog import QUERIES
from tests.conftest import SF

ARROW_OPS = ("ArrowEvalPython", "MapInPandas", "FlatMapCoGroupsInPandas", "FlatMapGroupsInPandas", "MapInArrow", "FlatMapCoGroupsInArrow",
             "FlatMapGroupsInArrow")


@pytest.fixture(scope="module")
def plans(spark):
    return {k: QUERIES[k](spark, SF)._jdf.queryExecution().executedPlan().toString() for k in sorted(QUERIES)}


def test_no_cross_products(plans):
    bad = [k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_python_only_arrow_batched(plans):
    assert [k for k, p in plans.items() if "BatchEvalPython" in p] == []
    python_keys = sorted(k for k, p in plans.items() if any(op in p for op in ARROW_OPS))
    # ROUGE-L (LCS), exact kNN / BERTScore blocks, the encoder plug-in
    for k in ("rouge_l", "knn_topk", "bertscore_from_vectors", "encode_stub"):
        assert k in python_keys
