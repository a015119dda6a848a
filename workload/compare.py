"""Run the registered queries beside their SQL and report where results differ.

Usage: python -m workload.compare [folder of the tables] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

from cargolens.session import build_session
from workload.oracle import oracle_sql
from workload.queries import queries


def open_oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(connection: duckdb.DuckDBPyConnection, sql: str, df: DataFrame) -> str | None:
    """A short description of the first difference, or None when results are equal."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    actual = _rows(df.columns, df.collect())
    if len(actual) != len(expected):
        return f"{len(actual)} rows instead of {len(expected)}"
    for got, want in zip(actual, expected):
        if got != want or [type(c) for c in got] != [type(c) for c in want]:
            return f"{got} instead of {want}"
    return None


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:]
    spark = build_session(
        "compare",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = open_oracle(folder)
    registered, statements = queries(), oracle_sql()
    failed = 0
    for name in chosen or registered:
        begin = time.time()
        try:
            if name in statements:
                problem = differences(connection, statements[name], registered[name](spark, folder))
            else:
                problem = f"no SQL, {registered[name](spark, folder).count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - begin:6.2f}s {name} {problem or ''}")
    unregistered = sorted(set(statements) - set(registered))
    print(f"{len(registered)} queries, {failed} differ, SQL without query: {unregistered}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
