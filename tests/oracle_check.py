"""Run registered queries against their SQL: ``python -m tests.oracle_check [folder] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from courtside.plans import registry
from courtside.session import get_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, folder: str, name: str, build, sql: str | None) -> str:
    df = build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows={len(got)} (no SQL)" if got else "EMPTY (no SQL)"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    problems = []
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(columns)}"
    types = {d[0]: str(d[1]) for d in result.description}
    kinds = {c: (k, types[c]) for c, k in df.dtypes if SAME.get(k, k) != types[c]}
    if kinds:
        problems.append(f"TYPES {kinds}")
    a, b = rows_of(df.columns, got), rows_of(columns, expected)
    if len(a) != len(b):
        problems.append(f"ROWS spark={len(a)} sql={len(b)}")
    if a != b:
        in_a, in_b = set(a), set(b)
        extra, missing = [r for r in a if r not in in_b][:2], [r for r in b if r not in in_a][:2]
        problems.append(f"VALUES {sorted(columns)}\n   spark={str(extra)[:900]}\n   sql  ={str(missing)[:900]}")
    if not b:
        problems.append("EMPTY")
    return "; ".join(problems) or f"ok rows={len(a)}"


def main() -> int:
    folder, names = "/root/testdata/sf0.01", []
    for arg in sys.argv[1:]:
        if arg.startswith("/"):
            folder = arg
        else:
            names.append(arg)
    spark = get_session(**{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false",
                           "spark__driver__memory": "8g", "spark__master": "local[8]"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), registry.oracle_sql(), 0
    for name, build in registry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, folder, name, build, sqls.get(name))
        except Exception as problem:  # noqa: BLE001
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:1200]}"
        bad += not (verdict.startswith("ok") or verdict.startswith("rows="))
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
