"""Run named queries and compare them with their SQL on DuckDB.

usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from recollect.catalog import all_queries  # noqa: E402


def canonical(rows: list[tuple], names: list[str]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and v == 0:
                v = 0.0
            vals.append(f"{type(v).__name__}:{v!r}")
        out.append("|".join(vals))
    return sorted(out)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(args.sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    known = all_queries()
    names = args.names or [
        n for n, q in known.items() if not args.module or q.build.__module__.endswith("." + args.module)
    ]
    bad = []
    for name in names:
        q = known[name]
        t = time.time()
        try:
            df = q.build(spark, args.sf)
            mine = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if q.sql is None:
                print(f"rows  {name:28s} {took:6.2f}s {len(mine)} rows", flush=True)
                continue
            t = time.time()
            res = con.execute(q.sql)
            cols = [d[0] for d in res.description]
            theirs = res.fetchall()
            took_sql = time.time() - t
            a, b = canonical(mine, df.columns), canonical(theirs, cols)
            ok = sorted(df.columns) == sorted(cols) and a == b
            print(f"{'ok' if ok else 'DIFF':5s} {name:28s} {took:6.2f}s sql {took_sql:5.2f}s {len(a)} vs {len(b)}", flush=True)
            if not ok:
                bad.append(name)
                print("   cols", sorted(df.columns), sorted(cols))
                sa, sb = set(a), set(b)
                for x in sorted(sa - sb)[:4]:
                    print("   spark", x[:300])
                for x in sorted(sb - sa)[:4]:
                    print("   sql  ", x[:300])
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
