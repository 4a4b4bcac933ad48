"""Compare registered queries with their DuckDB text: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(table):
    names = sorted(table.column_names)
    data = table.select(names).to_pylist()
    return names, sorted(([norm(r[n]) for n in names] for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return a == b


def compare(spark_table, duck_table):
    """None when equal, else a short text."""
    n1, r1 = rows_of(spark_table)
    n2, r2 = rows_of(duck_table)
    if n1 != n2:
        return f"columns {n1} / {n2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} / {len(r2)}\n  {r1[:2]}\n  {r2[:2]}"
    bad = [(a, b) for a, b in zip(r1, r2) if not all(close(x, y) for x, y in zip(a, b))]
    if bad:
        return f"{len(bad)} of {len(r1)} rows differ ({n1}), first {bad[0][0]} / {bad[0][1]}"
    for n in n1:
        t1, t2 = str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type)
        if t1 != t2 and not (t1.startswith("timestamp") and t2.startswith("timestamp")) and "string" not in t1:
            return f"type of {n}: {t1} / {t2}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from hitledger.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toArrow()
            took = time.time() - start
            if name not in oracle:
                print(f"rows {name} {got.num_rows} {took:.2f}s", flush=True)
                continue
            want = con.sql(oracle[name]).to_arrow_table()
            diff = compare(got, want)
        except Exception as e:  # report and go on
            diff, took = f"{type(e).__name__}: {str(e)[:700]}", time.time() - start
        if diff:
            failed += 1
            print(f"FAIL {name} {took:.2f}s {diff}", flush=True)
        else:
            print(f"ok   {name} {got.num_rows} {took:.2f}s", flush=True)
    print(f"failed={failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
