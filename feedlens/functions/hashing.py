"""Seeded, partitioning-independent randomness.

All shuffles, draws and coin flips derive from ``md5(seed:part:...:key)``; never ``rand()``.
The same text is computed by DuckDB (``md5(concat_ws(':', ...))``), which lets a second
engine check every seeded operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str):
        return F.col(c).cast("string")
    return F.lit(str(c))


def seeded_hash(seed, *parts) -> Column:
    """Hex md5 of ``seed:part1:part2...``; strings name columns, other values are literals."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_str(p) for p in parts]))


def key_digest(keys) -> Column:
    """SHA-256 of a NULL-aware, length-prefixed encoding of ``keys``: equal digests iff equal keys
    (up to SHA-256 collisions). Lets long text keys be grouped, sorted and joined as 64 hex chars."""
    parts = []
    for k in keys:
        v = (F.col(k) if isinstance(k, str) else k).cast("string")
        parts.append(F.when(v.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.length(v).cast("string"),
                                                                         F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def hash_bits(hexcol: Column, start: int = 1, digits: int = 15) -> Column:
    """Unsigned integer of ``digits`` hex digits (60 bits) of an md5 string, from 1-based ``start``."""
    return F.conv(F.substring(hexcol, start, digits), 16, 10).cast("bigint")


def coin(seed, *parts) -> Column:
    """A fair seeded coin: True when the first hex digit of the hash is below 8."""
    return F.substring(seeded_hash(seed, *parts), 1, 1) < F.lit("8")


# ---- DuckDB counterparts (used by the oracle texts) ----

def sql_hash(seed, *parts: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5(concat_ws(':', {inner}))"


def sql_bits(hexexpr: str, start: int = 1, digits: int = 15) -> str:
    return f"CAST(('0x' || substr({hexexpr}, {start}, {digits})) AS BIGINT)"
