"""Compare every catalogue query with its DuckDB oracle (the driver's gate).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: exact / approx / FAIL with the reason.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from cohortlens.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "is_finite") and not isinstance(v, int):  # Decimal
        return float(v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]


def _key(row):
    return tuple((0, "") if v is None else (1, v) if isinstance(v, (int, float)) else (2, str(v)) for v in row)


def compare(a, b, tol=1e-9):
    if len(a) != len(b):
        return "rows", f"{len(a)} vs {len(b)}"
    sa, sb = sorted(a, key=_key), sorted(b, key=_key)
    if sa == sb:
        return "exact", ""
    bad = 0
    first = None
    for x, y in zip(sa, sb):
        for u, v in zip(x, y):
            same = u == v or (
                isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= tol * max(1.0, abs(u))
            )
            if not same:
                bad += 1
                first = first or (x, y)
                break
    return ("approx", "") if bad == 0 else ("FAIL", f"{bad} rows differ, e.g. {first}")


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as entry
    from cohortlens.session import local_session

    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    summary = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            cols_s, rows_s = rows_of_spark(fn(spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            summary[name] = "error"
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:24s} rows-only  {len(rows_s)} rows  {ts:.1f}s")
            summary[name] = "rows-only"
            continue
        try:
            cols_d, rows_d = rows_of_duck(con, sqls[name])
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            summary[name] = "error"
            continue
        if cols_s != cols_d:
            print(f"{name:24s} FAIL columns {cols_s} vs {cols_d}")
            summary[name] = "FAIL"
            continue
        status, why = compare(rows_s, rows_d)
        summary[name] = status
        print(f"{name:24s} {status:6s} {len(rows_s)} rows  {ts:.1f}s {why[:400]}")
    print({k: sum(1 for v in summary.values() if v == k) for k in set(summary.values())})
    return summary


if __name__ == "__main__":
    main(sys.argv)
