"""Joins to counted keys, some of which may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has one row per combination of ``keys``
    (none null) and in ``weight`` its number of rows. Keys with at least a 1,024th of all rows, so
    1,024 keys at most, are broadcast; no hot key is shuffled. Columns besides the keys differ."""
    told = [c for c in counted.columns if c not in keys]
    many = F.col(weight) * 1024 >= counted.agg(F.sum(weight)).scalar()
    hot = counted.filter(many).select(*keys, F.struct(*told).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    warm = marked.filter("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    cold = marked.filter("_hot IS NULL").select(*rows.columns).join(counted.filter(~many), keys).select(*rows.columns, *told)
    return warm.unionByName(cold)
