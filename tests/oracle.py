"""Compare every registered query with its SQL on DuckDB: rows, columns and values.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, function, sql) -> str | None:
    """None when equal, else what differs."""
    df = function(spark, sf_dir)
    got_names, got = rows_by_name(df.columns, df.collect())
    cursor = con.execute(sql)
    want_names, want = rows_by_name([c[0] for c in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} instead of {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}; e.g. {sorted(set(map(repr, got)) ^ set(map(repr, want)))[:4]}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"row {a!r:.400} instead of {b!r:.400}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from weftgrid.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="12g",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, function in queries().items():
        if args and name not in args:
            continue
        started = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                result = f"rows only: {len(function(spark, sf_dir).collect())}"
            else:
                problem = compare(spark, con, sf_dir, function, sql)
                failed += problem is not None
                result = "ok" if problem is None else f"DIFFERS {problem}"
        except Exception as error:  # noqa: BLE001 - the report goes on
            failed += 1
            result = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{time.time() - started:6.2f}s {name}: {result}", flush=True)
    print(f"{failed} of {len(queries())} differ or failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
