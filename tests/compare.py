"""Run registered queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = rows(got_cols, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got), "no twin"
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    if sorted(got_cols) != sorted(want_cols):
        return False, len(got), f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    want = rows(want_cols, cur.fetchall())
    if got == want:
        return True, len(got), ""
    wanted = set(map(repr, want))
    extra = [r for r in got if repr(r) not in wanted][:2]
    have = set(map(repr, got))
    missing = [r for r in want if repr(r) not in have][:2]
    return False, len(got), f"{len(got)} vs {len(want)} rows; extra {extra}; missing {missing}; columns {sorted(got_cols)}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from folioframe.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, n, note = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            ok, n, note = False, -1, str(exc)[:1500]
        if ok is False:
            bad += 1
        print(f"{'ok  ' if ok else 'none' if ok is None else 'FAIL'} {name:38s} {n:7d} rows {time.time()-start:6.2f}s {note[:1800]}", flush=True)
    print("failures:", bad)
