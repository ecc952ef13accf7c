"""Run registered queries on Spark and DuckDB and compare rows.

``python -m tests.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / name}.parquet'")
    return connection


def _sorted_rows(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shuffled = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shuffled, key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return _sorted_rows(df.columns, df.collect())


def oracle_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    return _sorted_rows([c[0] for c in result.description], result.fetchall())


def first_difference(spark, connection, sf_dir: str, name: str) -> str | None:
    """None if both engines agree, else what differs first."""
    got_columns, got = spark_rows(queries()[name](spark, sf_dir))
    want_columns, want = oracle_rows(connection, oracle_sql()[name])
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"{mine} != {theirs}"
    return None if got else "no rows"


def main(arguments: list[str]) -> int:
    from tests.conftest import build_session

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or sorted(queries())
    spark, connection = build_session(), oracle_connection(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            difference = first_difference(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            difference = str(error)[:800]
        bad += difference is not None
        print(f"{'ok ' if difference is None else 'BAD'} {name} {time.time() - started:.1f}s "
              f"{difference or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
