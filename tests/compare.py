"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/compare.py [-d sf_dir] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = sorted(set(map(repr, got[1])) - set(map(repr, want[1])))[:2]
        lost = sorted(set(map(repr, want[1])) - set(map(repr, got[1])))[:2]
        return f"{len(got[1])} rows != {len(want[1])}; only here {extra}; only there {lost}"[:1500]
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, x, y) for c, x, y in zip(got[0], g, w) if x != y]
        return f"{len(bad)} of {len(got[1])} rows differ, first: {str(cells)[:1200]}"
    return None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> int:
    import __spark_entry__ as e

    args = argparse.ArgumentParser()
    args.add_argument("-d", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(opts.d)
    failed = 0
    oracles = e.oracle_sql()
    for name, run in e.queries().items():
        if opts.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in opts.names):
            continue
        t = time.time()
        try:
            df = run(spark, opts.d)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                took = time.time() - t
                print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.1f}s {problem or ''}", flush=True)
                failed += problem is not None
            else:
                print(f"rows {name} {df.count()} {time.time() - t:.1f}s", flush=True)
        except Exception as error:
            failed += 1
            print(f"ERR  {name} {time.time() - t:.1f}s {type(error).__name__} {str(error)[:1200]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
