"""Run registered queries beside their SQL and compare columns, rows and values."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cliptide.catalog import ORACLES, QUERIES  # noqa: E402
from cliptide.session import get_session  # noqa: E402


def plain(value: object) -> object:
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{args.sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    names = [n for n in QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            if args.explain:
                df.explain("formatted")
            got = [tuple(r) for r in df.collect()]
            took = time.time() - began
            if name not in ORACLES:
                print(f"rows  {name:34s} {len(got):7d} rows {took:6.2f}s {df.dtypes}", flush=True)
                continue
            began = time.time()
            cur = con.execute(ORACLES[name])
            cols = [c[0] for c in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - began
            same_cols = sorted(cols) == sorted(df.columns)
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            ok = same_cols and a == b
            bad += not ok
            state = "ok   " if ok else "FAIL "
            print(f"{state} {name:34s} {len(got):7d} rows {took:6.2f}s sql {sql_took:5.2f}s", flush=True)
            if not ok:
                print("   columns", sorted(df.columns), sorted(cols), "rows", len(got), len(want))
                print("   types", df.dtypes, [str(c[1]) for c in cur.description])
                print("   spark only", list((a - b).items())[:4])
                print("   sql only  ", list((b - a).items())[:4])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
