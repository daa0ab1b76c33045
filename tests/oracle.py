"""Run a registered query and its SQL over the same tables, and compare the rows.

``python tests/oracle.py SF_DIR [name ...]`` checks queries from the command line.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
    "float": "FLOAT", "tinyint": "TINYINT", "date": "DATE",
}


def compare(frame, connection, sql: str) -> tuple[int, list[str]]:
    """Row count and a list of differences, empty when all rows and types agree."""
    result = connection.execute(sql)
    expected_names = [d[0] for d in result.description]
    expected_types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    problems = []
    if sorted(frame.columns) != sorted(expected_names):
        return 0, [f"columns {sorted(frame.columns)} != {sorted(expected_names)}"]
    for name, kind in frame.dtypes:
        if _TYPES.get(kind, kind) != expected_types[name]:
            problems.append(f"type of {name}: {kind} != {expected_types[name]}")
    actual = [tuple(row) for row in frame.collect()]
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} != {len(expected)}")
    left, right = _sorted(frame.columns, actual), _sorted(expected_names, expected)
    if left != right:
        only_left, only_right = set(left) - set(right), set(right) - set(left)
        problems.append(f"{len(only_left)} rows only in Spark, e.g. {sorted(only_left)[:2]}"[:600])
        problems.append(f"{len(only_right)} rows only in SQL, e.g. {sorted(only_right)[:2]}"[:600])
    return len(actual), problems


def main() -> int:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            frame = build(spark, sf_dir)
            if name in oracles:
                rows, problems = compare(frame, connection, oracles[name])
            else:
                rows, problems = frame.count(), []
        except Exception as error:  # noqa: BLE001 - reported per query
            rows, problems = 0, [f"{type(error).__name__}: {str(error)[:1200]}"]
        bad += bool(problems)
        state = "FAIL" if problems else ("ok" if name in oracles else "ok (rows only)")
        print(f"{state:5} {name} rows={rows} {time.time() - start:.2f}s", flush=True)
        for problem in problems:
            print("      ", problem, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
