"""Compare registered queries with their SQL in DuckDB: ``python -m postmill.plans.check [name ...]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> str:
    start = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return f"rows {len(got)} ({took:.1f}s)"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"DIFFER spark={len(got)} sql={len(want)} first={str(first)[:600]}"
    return f"ok {len(got)} ({took:.1f}s)"


def main() -> None:
    import duckdb

    from postmill.plans.catalog import ORACLE, QUERIES
    from postmill.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("local[8]", "postmill-check", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if args and name not in args:
            continue
        try:
            verdict = compare(spark, con, name, fn, ORACLE.get(name), sf)
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:500]}"
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name}: {verdict}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
