"""Runs registered queries against their SQL on DuckDB.

    python tools/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from citeframe.plans.catalog import ORACLES, QUERIES  # noqa: E402
from citeframe.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return f"{value:.6g}" if value != int(value) or abs(value) > 1e15 else f"{value:.1f}"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = build_session("compare", "local[8]", shuffle_partitions=8, driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name, plan in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        df = plan(spark, sf_dir)
        got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        took = time.time() - started
        if name not in ORACLES:
            print(f"{name:28s} rows={sum(got.values()):8d} {took:6.1f}s  (no SQL)", flush=True)
            continue
        result = con.execute(ORACLES[name])
        want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
        same = got_cols == want_cols and got == want
        bad += not same
        print(f"{name:28s} rows={sum(got.values()):8d} {took:6.1f}s  {'ok' if same else 'DIFFERS'}", flush=True)
        if not same:
            print("   columns", got_cols, want_cols)
            print("   only Spark ", list((got - want).items())[:3])
            print("   only DuckDB", list((want - got).items())[:3], "of", sum(want.values()), flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
