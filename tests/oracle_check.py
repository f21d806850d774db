"""Run registered queries on Spark and DuckDB and compare them value by value.

``python tests/oracle_check.py [--sf 0.01] [name ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, run, sql, folder) -> str | None:
    """None if equal, else what differs."""
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if any(isinstance(v, (list, dict)) for row in want for v in row):
        return "nested values"
    if got != want:
        only_spark, only_duck = got - want, want - got
        return (
            f"{sum(got.values())} vs {sum(want.values())} rows; only spark {sum(only_spark.values())} "
            f"e.g. {list(only_spark)[:2]}; only duckdb {list(only_duck)[:2]} (cols {sorted(names)})"
        )
    types = {n: t for n, t in df.dtypes}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    wide = [n for n, t in duck_types.items() if t in ("HUGEINT", "DECIMAL")]
    if wide:
        return f"type mismatch: {[(n, duck_types[n], types[n]) for n in wide]}"
    return None


def main() -> None:
    from packetlake.session import build_session
    from registry import catalog

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "oracle-check",
        **{
            "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    names = [
        n for n in catalog.QUERIES
        if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args)
    ]
    bad = 0
    for name in names:
        began = time.time()
        try:
            problem = compare(
                spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), folder
            )
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        mark = "ok" if problem is None else "BAD"
        bad += problem is not None
        kind = "" if name in catalog.ORACLES else " (no oracle)"
        print(f"{mark:4s}{time.time() - began:6.2f}s {name}{kind} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
