"""Runs registered queries against their SQL in DuckDB: `python tools/compare.py sf0.01 [name prefix ...]`."""

from __future__ import annotations

import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6g}" if abs(value) >= 1e15 else repr(round(value, 6) + 0.0)
    if isinstance(value, decimal.Decimal) and value == value.to_integral_value():
        return repr(int(value))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, build, sql):
    start = time.time()
    df = build(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return ("rows", len(got), None, took, "")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    expected = want.fetchall()
    if sorted(columns) != sorted(df.columns):
        return ("COLUMNS", len(got), len(expected), took, f"{sorted(df.columns)} != {sorted(columns)}")
    left, right = rows_of(df.columns, got), rows_of(columns, expected)
    if left == right:
        return ("ok" if left else "EMPTY", len(got), len(expected), took, "")
    extra, missing = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
    return ("DIFF", len(got), len(expected), took, f"\n   cols {sorted(columns)}\n   spark {extra}\n   duck  {missing}")


def main() -> int:
    import duckdb

    from doorlens.plans import registry
    from doorlens.plans.analogs import TABLES
    from doorlens.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    sqls = registry.all_sql()
    bad = 0
    for name, build in sorted(registry.all_queries().items()):
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            status, got, want, took, note = compare(spark, con, sf_dir, name, build, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            status, got, want, took, note = "ERROR", 0, 0, 0.0, str(error)[:700]
        bad += status not in ("ok", "rows")
        print(f"{status:8}{name:40} {got!s:>8} {want!s:>8} {took:6.1f}s {note}", flush=True)
    print("failures", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
