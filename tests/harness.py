"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (1, "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0)
    return (2, str(v))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((a, str(b)) for a, b in r))


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    """Empty string when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return "" if df.columns else "no columns"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2]
        lacking = [r for r in b if r not in set(a)][:2]
        return f"{len(a)} rows != {len(b)}; extra {extra}; lacking {lacking}"
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            same = p == q or (isinstance(p[1], float) and isinstance(q[1], float) and abs(p[1] - q[1]) <= 2e-6)
            if not same:
                return f"{sorted(cols)}: {x} != {y}"
    return "" if a or not want else "empty"


if __name__ == "__main__":
    from queries import load
    from tilewright.session import local_session
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    queries, oracles = load()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            msg = compare(spark, con, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(msg)
        print(f"{'ok ' if not msg else 'BAD'} {time.time() - t:6.1f}s {'sql ' if name in oracles else 'rows'} {name} {msg}", flush=True)
    print("failures", bad)
