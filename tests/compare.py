"""Run registered queries against their SQL: `python -m tests.compare [sf] [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry
from meterline.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        if isinstance(v, float) and v == 0:
            return "0.0"
        return repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got)})"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    a, b = canonical(got, df.columns), canonical(want, names)
    if a == b:
        return f"ok ({len(got)})"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"DIFFER {len(a)} vs {len(b)} rows; {sorted(names)}; {diff}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master=f"local[{os.environ.get('BENCH_CPUS', '8')}]",
                          **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as problem:  # noqa: BLE001
            verdict = f"FAILED {type(problem).__name__}: {str(problem)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
