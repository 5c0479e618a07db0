"""Run registered queries against DuckDB on the same tables: ``verify.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spanloom.registry import all_oracles, all_queries  # noqa: E402
from spanloom.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if v is None or isinstance(v, (bool, int, str)):
        return str(v)
    return f"{type(v).__name__}:{v}"


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return f"rows-only {len(rows)}", bool(rows), rows
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", False, rows
    at = [names.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())
    if rows == want:
        return f"{len(rows)} rows", bool(rows), rows
    a, b = set(rows), set(want)
    return f"{len(rows)} vs {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}", False, rows


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(os.environ.get("VERIFY_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = all_oracles()
    bad = 0
    for name, fn in all_queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        at = time.time()
        try:
            note, ok, _ = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            note, ok = f"{type(e).__name__}: {str(e)[:600]}", False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {time.time() - at:5.1f}s {name}: {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
