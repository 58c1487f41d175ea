"""Compare registered queries with their SQL: ``python -m tests.compare [sf folder] [name prefix …]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else v)
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, con, fn, sql, folder) -> str | None:
    df = fn(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        extra, lacking = sorted(a - b)[:3], sorted(b - a)[:3]
        return f"rows {len(got[1])} vs {len(want[1])}; only spark ({len(a-b)}): {extra}; only sql ({len(b-a)}): {lacking}"[:1500]
    if not got[1]:
        return "no rows"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from recollect.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session(), connect(folder)
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        begin = time.time()
        try:
            if name in sqls:
                problem = difference(spark, con, fn, sqls[name], folder)
                kind = "sql"
            else:
                kind, problem = f"{len(fn(spark, folder).collect())} rows", None
        except Exception as e:  # noqa: BLE001
            kind, problem = "error", f"{type(e).__name__}: {e}"[:1800]
        print(f"{'FAIL' if problem else 'ok  '} {name} {kind} {time.time() - begin:.1f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
