"""Run queries next to their DuckDB oracles: python tools/check.py [--sf 0.001] [key-prefix ...]"""

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from ledgerloom.plans import registry  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402


def canon(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6f}" if value != int(value) or abs(value) > 1e15 else f"{int(value)}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, key, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    if sql is None:
        df.write.format("noop").mode("overwrite").save()
        n = -1
        return ("rows", n, time.time() - start, "")
    got = df.collect()
    took = time.time() - start
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    oracle_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return ("FAIL", len(got), took, f"columns {sorted(df.columns)} != {sorted(names)}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return ("ok" if a else "EMPTY", len(a), took, f"oracle {oracle_took:.1f}s")
    sa, sb = set(a), set(b)
    only_a = [r for r in a if r not in sb][:3]
    only_b = [r for r in b if r not in sa][:3]
    return ("FAIL", len(a), took, f"rows {len(a)} vs {len(b)}\n   cols  {sorted(names)}\n   spark {only_a}\n   duck  {only_b}")


def connect(sf_dir):
    con = duckdb.connect()
    for name in registry.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("--modules", default=None)
    ap.add_argument("--no-oracle", action="store_true", help="only run and count the Spark side")
    ap.add_argument("--zone", default=None, help="run the Spark session in another time zone")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    if args.modules:
        registry.MODULES[:] = args.modules.split(",")
    queries, oracles = registry.load()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    if args.zone:
        spark.conf.set("spark.sql.session.timeZone", args.zone)
    con = connect(sf_dir)
    bad = []
    for key, fn in queries.items():
        if args.keys and not any(key.startswith(k) for k in args.keys):
            continue
        try:
            status, n, took, note = compare(spark, con, sf_dir, key, fn, None if args.no_oracle else oracles.get(key))
        except Exception as e:  # report and go on to the next query
            status, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{status:6} {key:28} n={n:<8} {took:5.1f}s {note}", flush=True)
        if status in ("FAIL", "ERROR", "EMPTY"):
            bad.append(key)
    print(f"{len(bad)} bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
