"""Run registered Spark queries and their DuckDB oracles side by side.

    python tools/compare.py [--sf /root/testdata/sf0.01] [key ...]

Prints one line per key: OK / MISMATCH / ERROR with row counts. Values are
normalised (floats to 6 places, -0.0 -> 0.0, timestamps to ISO text) and
compared as order-insensitive multisets over name-sorted columns.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ranktide.catalog.registry import load_all  # noqa: E402
from ranktide.session import build_session  # noqa: E402
from ranktide.sources.bridge import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = round(float(v), 6)
        return 0.0 if f == 0 else f
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in rows], [cols[i] for i in order]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    reg = load_all()
    keys = a.keys or sorted(reg)
    spark = build_session(f"local[{os.environ.get('COMPARE_CPUS', '8')}]")
    if os.environ.get("SESSION_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["SESSION_TZ"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for k in keys:
        e = reg[k]
        t0 = time.time()
        try:
            df = e.build(spark, a.sf)
            srows = df.collect()
            scols = df.columns
            ts = time.time() - t0
            if e.sql is None:
                print(f"{k:32s} NO-ORACLE spark_rows={len(srows)} {ts:.1f}s")
                continue
            cur = con.execute(e.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            sr, sc = rows_of(scols, srows)
            dr, dc = rows_of(dcols, drows)
            if sc != dc:
                bad += 1
                print(f"{k:32s} SCHEMA spark={sc} duck={dc}")
                continue
            cs, cd = Counter(sr), Counter(dr)
            if cs == cd:
                print(f"{k:32s} OK rows={len(sr)} {ts:.1f}s")
            else:
                bad += 1
                only_s = list((cs - cd).elements())[:3]
                only_d = list((cd - cs).elements())[:3]
                print(f"{k:32s} MISMATCH spark={len(sr)} duck={len(dr)} cols={sc}\n   spark-only {only_s}\n   duck-only  {only_d}")
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"{k:32s} ERROR {type(ex).__name__}: {str(ex)[:600]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"bad={bad} of {len(keys)}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
