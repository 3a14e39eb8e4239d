"""Run registered Spark checks against their DuckDB oracle SQL (local harness).

Usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
Mirrors the driver's compare: row count, sorted column names, and an
order-insensitive comparison of the rows (doubles compared after rounding).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from quarry.registry import TABLES, spark_queries, sql_queries  # noqa: E402
from quarry.session import get_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if v is None:
        return "None"
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = spark_queries(), sql_queries()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS-ONLY  {name}: {len(srows)} rows  {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL   {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"MISMATCH   {name}: columns {sorted(scols)} vs {sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a == b:
            print(f"OK         {name}: {len(a)} rows  {ts:.1f}s")
        else:
            bad += 1
            print(f"MISMATCH   {name}: spark {len(a)} rows, sql {len(b)} rows")
            sa, sb = set(a), set(b)
            for r in sorted(sa - sb)[:4]:
                print("   spark only:", r)
            for r in sorted(sb - sa)[:4]:
                print("   sql only:  ", r)
    print("bad:", bad)


if __name__ == "__main__":
    main()
