"""Compare registered queries with their SQL: python tests/check_sql.py [sf_dir] [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def oracle(sf_dir: str, sql: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = connection.execute(sql)
    columns = [entry[0] for entry in cursor.description]
    return columns, cursor.fetchall()


def differences(spark, sf_dir: str, name: str, run, sql: str | None):
    """Row count, seconds and the first difference (None when equal)."""
    started = time.perf_counter()
    frame = run(spark, sf_dir)
    got = [tuple(row) for row in frame.collect()]
    seconds = time.perf_counter() - started
    if sql is None:
        return len(got), seconds, None
    columns, expected = oracle(sf_dir, sql)
    if sorted(columns) != sorted(frame.columns):
        return len(got), seconds, f"columns {sorted(frame.columns)} against {sorted(columns)}"
    left, right = rows_of(frame.columns, got), rows_of(columns, expected)
    if left == right:
        return len(got), seconds, None
    extra = sorted(set(left) - set(right))[:2]
    lacking = sorted(set(right) - set(left))[:2]
    return len(got), seconds, f"{len(left)} against {len(right)} rows; {extra} / {lacking}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from nearfield.session import local_session

    arguments = sys.argv[1:]
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    wanted = arguments[1:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    sql = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        try:
            count, seconds, problem = differences(spark, sf_dir, name, run, sql.get(name))
        except Exception as error:
            count, seconds, problem = 0, 0.0, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        state = "FAIL" if problem else ("same" if name in sql else "rows")
        print(f"{state} {name} {count} rows {seconds:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
