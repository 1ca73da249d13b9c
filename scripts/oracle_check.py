"""Run registered queries in Spark and their SQL texts in DuckDB; compare rows like the driver.

usage: python scripts/oracle_check.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

import duckdb  # noqa: E402

from feedlens.catalog import BRUTE, ORACLE, QUERIES  # noqa: E402
from feedlens.session import local_session  # noqa: E402
from feedlens.sources.views import BASE_TABLES  # noqa: E402
from tests.brute import register_duckdb  # noqa: E402


def norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = local_session()
    con = duckdb.connect()
    register_duckdb(con)
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    keys = a.keys or sorted(QUERIES)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = QUERIES[k](spark, a.sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            traceback.print_exc(limit=3)
            continue
        ts = time.time() - t0
        sql = ORACLE.get(k) or BRUTE.get(k)
        if sql is None:
            print(f"ROWS {k}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        tag = "OK  " if k in ORACLE else "OK* "  # OK*: SQL plus the brute-force LCS function
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {k}: duckdb error {str(e)[:600]}")
            continue
        if sorted(cols) != sorted(dcols):
            bad += 1
            print(f"FAIL {k}: columns spark={sorted(cols)} duck={sorted(dcols)}")
            continue
        s, d = rows_of(cols, srows), rows_of(dcols, drows)
        if s == d:
            print(f"{tag} {k}: {len(s)} rows {ts:.1f}s")
        else:
            bad += 1
            ss, dd = set(s), set(d)
            print(f"FAIL {k}: rows spark={len(s)} duck={len(d)}; cols={sorted(cols)}")
            for r in list(ss - dd)[:3]:
                print("   spark only:", repr(r)[:400])
            for r in list(dd - ss)[:3]:
                print("   duck  only:", repr(r)[:400])
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main()
