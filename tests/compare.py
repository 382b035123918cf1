"""Run a query and its checking SQL side by side and report the first difference."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "tolist"):
        return tuple(_plain(v) for v in value.tolist())
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = [tuple(_plain(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    left, right = rows(spark_frame), rows(sql_frame)
    if len(left) != len(right):
        only = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}; {only}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0]}"
    kinds = lambda f: {c: f[c].dtype.kind for c in sorted(f.columns)}
    a, b = kinds(spark_frame), kinds(sql_frame)
    if left and a != b:
        print(f"      note: dtypes {[(c, str(spark_frame[c].dtype), str(sql_frame[c].dtype)) for c in a if a[c] != b[c]]}")
    return None


def main(names: list[str], sf_dir: str) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from statuteflow.session import build_session

    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, checks, failed = entry.queries(), entry.oracle_sql(), 0
    for name, run in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            t0 = time.time()
            got = run(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in checks:
                want = con.execute(checks[name]).df()
                problem = compare(got, want)
            else:
                problem = None
            mark = "ok " if problem is None else "BAD"
            print(f"{mark} {name:38s} rows={len(got):7d} spark={t1 - t0:6.2f}s sql={time.time() - t1:6.2f}s"
                  + ("" if name in checks else "  (rows only)") + ("" if len(got) else "  EMPTY"), flush=True)
            if problem:
                failed += 1
                print("     ", problem[:1500], flush=True)
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERR {name}: {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    sys.exit(1 if main(args, sf) else 0)
