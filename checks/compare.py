"""Run registered queries beside their SQL twins and compare whole results.

    python -m checks.compare [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = con.sql(sql).to_arrow_table()
    names = frame.column_names
    return names, [tuple(r[n] for n in names) for r in frame.to_pylist()]


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, round(float(value), 3))
    return (3, str(value))


def difference(spark_names, spark_rows, names, rows) -> str | None:
    """None when both results agree, else the first thing that differs."""
    if sorted(spark_names) != sorted(names):
        return f"columns {sorted(spark_names)} != {sorted(names)}"
    order = sorted(names)
    left = [tuple(dict(zip(spark_names, r))[n] for n in order) for r in spark_rows]
    right = [tuple(dict(zip(names, r))[n] for n in order) for r in rows]
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    sort = lambda rs: sorted(rs, key=lambda r: [_key(v) for v in r])
    for a, b in zip(sort(left), sort(right)):
        for n, x, y in zip(order, a, b):
            if x is None or y is None or isinstance(x, str) or isinstance(y, str):
                same = x == y
            elif isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = type(x) is type(y) and (
                    x == y or (math.isnan(x) and math.isnan(y)) if isinstance(x, float) else x == y
                )
            else:
                same = x == y
            if not same:
                return f"column {n}: {x!r} != {y!r} in {a} / {b}"
    return None


def main(argv: list[str]) -> int:
    from checks import ORACLES, QUERIES
    from checks.local import session

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            verdict = f"rows only ({len(rows)})"
            if name in ORACLES:
                out, expected = sql_rows(sf_dir, ORACLES[name])
                problem = difference(df.columns, rows, out, expected)
                failed += problem is not None
                verdict = f"ok {len(rows)} rows" if problem is None else f"DIFF {problem}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            failed += 1
            took, verdict = time.time() - start, f"ERROR {str(error)[:1500]}"
        print(f"{name:28s} {took:6.2f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
