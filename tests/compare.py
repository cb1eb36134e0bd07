"""Compare registered queries with their SQL in DuckDB, as the driver does."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [cell(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names: list[str], data: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([cell(r[i]) for i in order]) for r in data)


def compare(spark, name: str, sf_dir: str) -> tuple[bool, str]:
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = views(sf_dir).execute(e.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(cols)}"
    a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return got == want, f"{len(got)} rows, {len(want)} in SQL" + ("" if got == want else f"; only here {a[:3]}; only there {b[:3]}")


if __name__ == "__main__":
    import __spark_entry__ as e
    from lumenarray.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    for name in sys.argv[2:] or e.queries():
        t = time.time()
        try:
            ok, what = compare(spark, name, sf_dir) if name in e.oracle_sql() else (None, f"{e.queries()[name](spark, sf_dir).count()} rows, no SQL")
        except Exception as x:  # noqa: BLE001
            ok, what = False, f"{type(x).__name__}: {str(x)[:3000]}"
        print("ok  " if ok else "rows" if ok is None else "FAIL", name, f"{time.time() - t:.1f} s", what, flush=True)
