"""Run registered queries against their SQL twins in DuckDB and report differences.

usage: python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from bellwire.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    from bellwire.registry import ENTRIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = []
    for name, e in ENTRIES.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        start = time.time()
        try:
            df = e.run(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: {str(exc)[:1500]}", flush=True)
            bad.append(name)
            continue
        if e.sql is None:
            print(f"rows {name}: {len(got)} rows {took:.2f}s {got[:2]}"[:300], flush=True)
            continue
        try:
            cur = con.execute(e.sql)
            cols = [d[0] for d in cur.description]
            types = [str(d[1]) for d in cur.description]
            want = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"SQL  {name}: {str(exc)[:1500]}", flush=True)
            bad.append(name)
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if sorted(df.columns) != sorted(cols):
            print(f"COLS {name}: {sorted(df.columns)} vs {sorted(cols)}", flush=True)
            bad.append(name)
        elif a != b:
            only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            print(f"DIFF {name}: {len(a)} vs {len(b)} rows; spark only {len(only_a)} {str(only_a[:2])[:600]} sql only {len(only_b)} {str(only_b[:2])[:600]}", flush=True)
            bad.append(name)
        else:
            spark_types = dict(df.dtypes)
            odd = [(c, spark_types[c], t) for c, t in zip(cols, types) if t in ("HUGEINT", "UHUGEINT") or t.startswith("DECIMAL")]
            print(f"ok   {name}: {len(a)} rows {took:.2f}s {odd or ''}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
