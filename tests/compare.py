"""Run registered queries beside their SQL in DuckDB and compare all rows, order aside."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _normal(value):
    if isinstance(value, Decimal):
        raise TypeError("decimals leave a query as doubles")
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_normal(row[i]) for i in order) for row in rows)


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Number of Spark rows, and what differs between the two results."""
    answer = connection.execute(sql)
    columns = [d[0] for d in answer.description]
    expected = _rows(columns, answer.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    problems += [f"only Spark {n}x {row}" for row, n in list((actual - expected).items())[:3]]
    problems += [f"only SQL   {n}x {row}" for row, n in list((expected - actual).items())[:3]]
    return sum(actual.values()), problems


def main(sf_dir: str, *names: str) -> int:
    import __spark_entry__ as entry
    from broadsheet.session import local_session

    spark, connection, failed = local_session(), duck(sf_dir), 0
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        if name in oracle:
            count, problems = differences(query(spark, sf_dir), connection, oracle[name])
        else:
            count, problems = query(spark, sf_dir).count(), []
        verdict = "ok" if not problems else "DIFFERENT"
        note = "" if name in oracle else " (rows only)"
        print(f"{verdict:9} {name:34} {count:8} rows {time.perf_counter() - start:6.2f}s{note}")
        for problem in problems:
            print("   ", problem)
        failed += bool(problems)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
