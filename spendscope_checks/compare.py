"""Runs registered queries in Spark and DuckDB and compares the rows.

    python -m spendscope_checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from spendscope.session import local_session

from . import queries, sql

# Spark type -> DuckDB types that hold the same values.
SAME_TYPES = {
    "int": {"INTEGER"},
    "bigint": {"BIGINT", "INTEGER", "HUGEINT", "SMALLINT"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _normal(value):
    return value + 0.0 if isinstance(value, float) else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_normal(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r)))


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, statement: str) -> list[str]:
    """What differs, if anything."""
    result = con.execute(statement)
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    problems = []
    if set(types) != set(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(types)}"]
    for field in df.schema.fields:
        name = field.dataType.simpleString()
        if types[field.name] not in SAME_TYPES.get(name, {name}):
            problems.append(f"{field.name} is {name} against {types[field.name]}")
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    right = _rows(list(types), expected)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows against {len(right)}")
    unlike = [(a, b) for a, b in zip(left, right) if a != b]
    if unlike:
        problems.append(f"{len(unlike)} rows differ, first {unlike[0][0]} against {unlike[0][1]}")
    return problems


def main(sf_dir: str, chosen: list[str]) -> int:
    spark: SparkSession = local_session(8)
    con = duck(sf_dir)
    failed = 0
    for name in chosen or queries.names():
        started = time.time()
        try:
            df = queries.run(name, spark, sf_dir)
            problems = differences(df, con, sql.oracle(name))
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s {'; '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
