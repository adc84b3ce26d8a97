"""Run queries in Spark and their SQL twins in DuckDB, and compare all values.

Usage: python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return cell(float(v))
    return str(v)


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


def compare(spark, con, name, run, sql, sf):
    start = time.time()
    df = run(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return spent, len(got), None, ""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want = rows_of(names, want.fetchall())
    if sorted(names) != sorted(df.columns):
        return spent, len(got), False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a = [r for r in got if r not in set(want)][:3]
        b = [r for r in want if r not in set(got)][:3]
        return spent, len(got), False, f"rows {len(got)} vs {len(want)}\n  cols  {sorted(names)}\n  spark {a}\n  duck  {b}"
    return spent, len(got), True, ""


if __name__ == "__main__":
    import __spark_entry__ as catalog
    from runloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = tuple(sys.argv[2:])
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = catalog.oracle_sql()
    bad = 0
    for name, run in catalog.queries().items():
        if wanted and not name.startswith(wanted):
            continue
        try:
            spent, n, same, note = compare(spark, con, name, run, sqls.get(name), sf)
        except Exception as error:  # report and go on with the other queries
            spent, n, same, note = 0.0, -1, False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += same is False
        print(f"{'ok ' if same else ('-- ' if same is None else 'BAD')} {name:34s} rows={n:7d} {spent:6.2f}s {note}", flush=True)
    print("mismatches:", bad)
