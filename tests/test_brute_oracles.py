"""Queries whose SQL check needs LCS over whole texts: Spark against DuckDB SQL with a
brute-force quadratic LCS registered as a scalar function, on the small fixture (sf0.001)."""

import duckdb
import pytest

from feedlens.catalog import BRUTE, QUERIES
from feedlens.sources.views import BASE_TABLES
from scripts.oracle_check import rows_of
from tests.brute import register_duckdb
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    register_duckdb(c)
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


def test_brute_keys_registered():
    assert set(BRUTE) == {"rouge_l", "rouge_means", "score_correlation", "system_correlation", "eval_reference"}


@pytest.mark.parametrize("key", sorted(BRUTE))
def test_spark_equals_brute_force(spark, con, key):
    df = QUERIES[key](spark, SF)
    s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(BRUTE[key])
    d = rows_of([x[0] for x in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(x[0] for x in cur.description)
    assert s == d
    assert len(s) > 0
