"""Run registered queries on Spark and their SQL on DuckDB; compare rows, columns and values.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from peakscreen import get_spark  # noqa: E402
from peakscreen.plans import catalog  # noqa: E402
from peakscreen.plans.views import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = catalog.all_queries(), catalog.all_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = {"status": "spark_error", "error": str(e)[:400]}
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = {"status": "rows_only", "rows": len(srows), "sec": round(t1 - t0, 2)}
            print(name, results[name], flush=True)
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = {"status": "sql_error", "error": str(e)[:400]}
            print(name, results[name], flush=True)
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        r = {"status": "match" if ok else "MISMATCH", "rows": [len(srows), len(drows)],
             "sec": round(t1 - t0, 2)}
        if sorted(scols) != sorted(dcols):
            r["cols"] = [sorted(scols), sorted(dcols)]
        if not ok and len(ls) and len(ld):
            diff_s = sorted(set(ls) - set(ld))[:3]
            diff_d = sorted(set(ld) - set(ls))[:3]
            r["spark_only"], r["sql_only"] = diff_s, diff_d
        results[name] = r
        print(name, json.dumps(r)[:600], flush=True)
    bad = [n for n, r in results.items() if r["status"] not in ("match", "rows_only")]
    print("SUMMARY", len(results), "checked;", "bad:", bad)


if __name__ == "__main__":
    main()
