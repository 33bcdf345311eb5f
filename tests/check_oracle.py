"""Compare named queries with their SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb

from snaplake.plans.inputs import TABLES


def normal(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(con, df, sql):
    """None when equal, else what differs."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:1]} {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    types = {n: t for n, t in df.dtypes}
    kinds = {d[0]: str(d[1]) for d in cur.description}
    return f"{len(bad)} rows differ, e.g.\n  spark {bad[0][0]}\n  sql   {bad[0][1]}" if bad else check_types(types, kinds)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP", "date": "DATE"}


def check_types(types, kinds):
    kinds = {n: k.replace("TIMESTAMP WITH TIME ZONE", "TIMESTAMP") for n, k in kinds.items()}
    types = {n: t.replace("timestamp_ntz", "timestamp") for n, t in types.items()}
    odd = [f"{n}: {t} / {kinds[n]}" for n, t in types.items() if SAME.get(t) != kinds[n]]
    return f"TYPES {odd}" if odd else None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from snaplake.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, wrong = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            result = compare(con, df, sql[name]) if name in sql else f"ROWS ONLY {df.count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__} {str(error)[:700]}"
        wrong += bool(result and not result.startswith(("ROWS", "TYPES")))
        print(f"{'ok  ' if result is None else 'BAD '} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("wrong", wrong, "of", len(queries()))


if __name__ == "__main__":
    main(sys.argv[1:])
