"""Run each registered query in Spark and its oracle SQL in DuckDB; compare.

Same rules as the driver's check: row count, column names, and the multiset
of rows with columns sorted by name.  Usable as a script:

    python tests/oracle_compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v  # exact: the doubles of both engines are compared bit for bit
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, sf_dir: str, names=None):
    from reclaim.plans.oracle import SQL
    from reclaim.plans.queries import QUERIES
    con = duck(sf_dir)
    results = {}
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        sql = SQL.get(name)
        df = fn(spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        if sql is None:
            results[name] = dict(ok=None, rows=len(s_rows), note="no oracle")
            continue
        try:
            cur = con.execute(sql)
        except Exception as e:  # report, go on with the rest
            results[name] = dict(ok=False, rows=len(s_rows), error=str(e)[:300])
            continue
        d_cols = [c[0] for c in cur.description]
        d_rows = cur.fetchall()
        ok_cols = sorted(s_cols) == sorted(d_cols)
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        ok = ok_cols and len(a) == len(b) and a == b
        info = dict(ok=ok, rows=len(s_rows), oracle_rows=len(d_rows))
        if not ok_cols:
            info["cols"] = (s_cols, d_cols)
        elif not ok:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            info["diff"] = diff
        results[name] = info
    return results


if __name__ == "__main__":
    from reclaim.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = 0
    for k, v in res.items():
        flag = "OK " if v["ok"] else ("-- " if v["ok"] is None else "BAD")
        bad += v["ok"] is False
        print(flag, k, {x: y for x, y in v.items() if x != "ok"}, flush=True)
    print("mismatches:", bad)
