"""Keep the first row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys, order_col: str) -> DataFrame:
    """The row with the smallest ``order_col`` for each key (pandas ``~duplicated(keys)``).

    ``min_by`` is an aggregate with a map-side partial step (sort-based, since its buffer holds
    the row as a struct), so a key holding a large share of the rows is reduced inside each input
    task before the shuffle (unlike a window, which would gather the whole key in one task).
    NULL keys form one group, as in pandas.
    """
    cols = df.columns
    packed = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(F.min_by(packed, F.col(order_col)).alias("_first")).select("_first.*").select(*cols)
