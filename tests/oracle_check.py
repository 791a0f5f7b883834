"""Run registered queries in Spark and their SQL in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Compares row count, column names and the multiset of rows (columns sorted by
name, values normalised), the way the driver's correctness gate does.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted([sorted(columns)][0]), sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_recs = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(key=key, status="rows-only", rows=len(s_recs), spark_s=round(t1 - t0, 2))
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_recs = cur.fetchall()
    sc, sr = _rows(s_cols, s_recs)
    dc, dr = _rows(d_cols, d_recs)
    ok = sc == dc and sr == dr
    info = dict(key=key, status="OK" if ok else "MISMATCH", rows=len(s_recs), oracle_rows=len(d_recs),
                spark_s=round(t1 - t0, 2))
    if not ok:
        if sc != dc:
            info["cols"] = (sc, dc)
        else:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            info["diff"] = diff
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from wattframe.session import get_session
    import __spark_entry__ as E
    extra = {}
    if os.environ.get("CHECK_TZ"):  # run in another session time zone to prove results do not depend on it
        extra["spark.sql.session.timeZone"] = os.environ["CHECK_TZ"]
    spark = get_session("local[8]", 8, extra=extra)
    spark.sparkContext.setLogLevel("OFF")
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in (keys or sorted(qs)):
        try:
            info = compare(spark, con, k, qs[k], ors.get(k), sf_dir)
        except Exception as e:  # report and go on
            info = dict(key=k, status="ERROR", error=repr(e)[:400])
        if info["status"] not in ("OK", "rows-only"):
            bad += 1
        print(info, flush=True)
    print(f"{len(keys or qs)} checked, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
