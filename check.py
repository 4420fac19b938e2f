"""Compare registered queries with their DuckDB counterparts: python check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from paperloom.checks import all_queries
from paperloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: normal(v) for k, v in value.items()})
    return repr(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    queries, oracles = all_queries()
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            if name not in oracles:
                print(f"rows-only {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            rel = con.sql(oracles[name])
            want = rel.fetchall()
            a, b = sorted_rows(df.columns, got), sorted_rows(rel.columns, want)
            types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            if sorted(df.columns) != sorted(rel.columns):
                bad += 1
                print(f"COLUMNS {name}: {sorted(df.columns)} / {sorted(rel.columns)}")
            elif a != b:
                bad += 1
                print(f"DIFF {name}: {len(a)} / {len(b)} rows")
                extra = [x for x in a if x not in set(b)][:2]
                missing = [x for x in b if x not in set(a)][:2]
                print("   only spark ", str(extra)[:1500])
                print("   only duckdb", str(missing)[:1500])
            else:
                print(f"ok {name}: {len(a)} rows {took:.1f}s {dict(df.dtypes) if os.environ.get('TYPES') else ''}{types if os.environ.get('TYPES') else ''}", flush=True)
        except Exception as exc:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL {name}: {str(exc)[:1200]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main()))
