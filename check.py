"""Compare catalogue queries with their SQL on DuckDB: python check.py [sf_dir] [name prefix ...]."""

from __future__ import annotations

import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

from transitframe.plans import catalog
from transitframe.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0 if math.isfinite(value) else str(value)
    if isinstance(value, bool):
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(_plain(r[i])) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    for module in ("texts", "lookups", "tables", "spatial", "resolution", "merging", "scans"):
        if Path(f"transitframe/plans/catalog/{module}.py").exists():
            importlib.import_module(f"transitframe.plans.catalog.{module}")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    bad = 0
    for name, run in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in catalog.ORACLES:
                print(f"rows {name:38s} {len(got[1]):7d} {took:6.2f}s", flush=True)
                continue
            start = time.time()
            result = con.execute(catalog.ORACLES[name])
            want = rows_of([c[0] for c in result.description], result.fetchall())
            oracle_took = time.time() - start
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL {name:38s} {str(error)[:600]}", flush=True)
            continue
        if got == want:
            print(f"ok   {name:38s} {len(got[1]):7d} {took:6.2f}s (sql {oracle_took:.2f}s)", flush=True)
        else:
            bad += 1
            extra, lost = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
            print(f"DIFF {name:38s} {len(got[1])} vs {len(want[1])} cols {got[0]} {want[0] if got[0] != want[0] else ''}", flush=True)
            print("     only here :", sorted(extra)[:3], "\n     only sql  :", sorted(lost)[:3], flush=True)
    print("problems:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
