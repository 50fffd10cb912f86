"""Run registered queries next to their SQL and compare every value.

    python tests/compare.py [--sf DIR] [--exact] NAME_PREFIX...
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else (float(v) if v != 0 else 0.0)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(v))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v)) if not hasattr(v, "hour") else str(pd.Timestamp(v))
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    out = [tuple(_norm(v) for v in row) for row in pdf.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(left: pd.DataFrame, right: pd.DataFrame, tol: float = 0.0) -> str | None:
    """None when equal, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = rows_of(left), rows_of(right)
    if a == b:
        return None
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if tol:
        def near(x, y):
            if isinstance(x, float) and isinstance(y, (int, float)) or isinstance(y, float) and isinstance(x, (int, float)):
                return abs(x - y) <= tol * max(1.0, abs(x), abs(y))
            if isinstance(x, tuple) and isinstance(y, tuple) and len(x) == len(y):
                return all(near(p, q) for p, q in zip(x, y))
            return x == y
        bad = [(x, y) for x, y in bad if not near(x, y)]
        if not bad:
            return None
    return f"{len(bad)} of {len(a)} rows differ, columns {sorted(left.columns)}; first: {bad[:2]}"


def run(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[str | None, float, int]:
    t = time.time()
    left = queries[name](spark, sf_dir).toPandas()
    took = time.time() - t
    if name not in oracles:
        return None, took, len(left)
    right = con.execute(oracles[name]).df()
    return compare(left, right), took, len(left)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidegrid.session import get_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    spark, con = get_session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            diff, took, n = run(spark, con, name, sf, queries, oracles)
            if n == 0:
                diff = diff or "no rows"
        except Exception as e:  # report and go on with the next query
            diff, took, n = f"{type(e).__name__}: {str(e)[:1500]}", 0.0, -1
        failed += diff is not None
        tag = "ok  " if diff is None else "FAIL"
        print(f"{tag} {name} rows={n} {took:.2f}s {'' if name in oracles else '(rows only) '}{diff or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
