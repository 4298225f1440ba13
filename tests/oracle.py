"""Compare registered queries with their check SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, entry, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = entry.plan(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if entry.sql is None:
        return True, f"{len(got)} rows, no check ({t1 - t0:.1f}s)"
    cur = con.execute(entry.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    note = f"{len(got)} rows ({t1 - t0:.1f}s / {time.time() - t1:.1f}s)"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            bad = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
            n = sum(x != y for x, y in zip(got, want))
            return False, f"{n} of {len(got)} rows differ, first {bad[:4]} in {g}"
    return True, note


def main(argv: list[str]) -> int:
    from barsmith.plans import registry
    from barsmith.session import get_spark

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    if len(argv) > 1 and argv[1].startswith("@"):
        registry.MODULES = tuple(argv[1][1:].split(","))
        wanted = []
    else:
        wanted = argv[1:]
    spark, con, bad = get_spark(cores="8"), connect(sf_dir), 0
    entries = registry.load_all()
    for name, e in entries.items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note = compare(spark, con, e, sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed of {len(wanted) or len(entries)}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
