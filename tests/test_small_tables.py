"""Registered queries over tables that a test builds."""

import pytest

from feedlens.catalog import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Writes documents (doc_id, text) and their labels; returns the folder."""
    def write(documents):
        rows = [(i, t, "en", "web", len(t or "")) for i, t in documents]
        spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(0, 1, 0)], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_normalise_results_of_an_item_without_an_answer(spark, tables):
    """Documents 4 and 5 are the gold and the random feedback of an item that has no knn feedback."""
    sf = tables([(i, f"text {i}") for i in range(6)])
    got = QUERIES["normalise_results"](spark, sf).collect()
    assert sorted((r.source, r.row_id, r.feedback) for r in got if r.source in ("og", "retrieved")) == [
        *[("og", i, f"text {i}") for i in range(6)], ("retrieved", 0, "text 2")]
