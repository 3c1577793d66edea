"""Run registered queries and their SQL side by side: python tests/oracle.py [sf] [names...]"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        if getattr(v, "tzinfo", None) is not None:
            v = v.replace(tzinfo=None)
        return v.isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = f" spark {time.time() - t0:.1f}s"
    if sql is None:
        return True, f"{len(got)} rows (no SQL){took}"
    res = con.execute(sql)
    want, wcols = rows_of([c[0] for c in res.description], res.fetchall())
    if gcols != wcols:
        return False, f"columns {gcols} != {wcols}"
    if got != want:
        g, w = set(got), set(want)
        return False, f"rows {len(got)} vs {len(want)}; only spark {list(g - w)[:2]}; only sql {list(w - g)[:2]}"
    return True, f"{len(got)} rows{took}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gatewright.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print("failed:", bad)
