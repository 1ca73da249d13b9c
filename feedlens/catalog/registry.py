"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the
result is expressible in SQL, the equivalent DuckDB text over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.rouge import sql_lcs_rows
from feedlens.sources.views import duck_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# The ROUGE-L texts once more, with a check-only scalar function (``lcs_dp``) in place of the fold
# over match points: run by tests with a brute-force implementation registered in DuckDB.
BRUTE: dict[str, str] = {}

DIGITS = 6  # reported doubles are rounded to this many digits in both engines


def query(name: str, views=(), sql: str | None = None, rouge: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = duck_with(list(views), sql)
        if rouge:
            BRUTE[name] = duck_with(list(views), sql.replace(sql_lcs_rows(), sql_lcs_rows("lcs_dp")))
        return fn

    return deco


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), DIGITS)


def sr6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), {DIGITS})"
