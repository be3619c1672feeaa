"""Run registered queries on Spark and their SQL twins on DuckDB and compare the values.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(x):
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        return repr(x)

    return sorted(tuple(cell(row[k]) for k in order) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir, inspect=None):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    if inspect:
        inspect(df)
    got = [tuple(x) for x in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = canonical(got, df.columns), canonical(want, cols)
    if a == b:
        return None if a else "no rows"
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} vs {len(b)}; columns {sorted(cols)}; spark only {only_a}; sql only {only_b}"


if __name__ == "__main__":
    from panelgrid.plans.catalog import ORACLE, QUERIES
    from panelgrid.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            diff = compare(spark, con, n, QUERIES[n], ORACLE.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'OK  ' if diff is None else 'FAIL'} {n} {time.time() - t:.2f}s"
              f"{'' if n in ORACLE else ' (rows only)'} {diff or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
