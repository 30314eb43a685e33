"""Run registered queries next to their SQL twins and report differences.

    python -m checks.compare <folder of tables> [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("rankloom")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _key(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, float):
        return (1, repr(value + 0.0))
    return (1, str(value))


def differences(columns_a, rows_a, columns_b, rows_b) -> str | None:
    """None when both results hold the same columns and the same rows in any order."""
    if sorted(columns_a) != sorted(columns_b):
        return f"columns {sorted(columns_a)} vs {sorted(columns_b)}"
    order_a = [columns_a.index(c) for c in sorted(columns_a)]
    order_b = [columns_b.index(c) for c in sorted(columns_b)]
    a = sorted(tuple(_key(row[i]) for i in order_a) for row in rows_a)
    b = sorted(tuple(_key(row[i]) for i in order_b) for row in rows_b)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            count = sum(p != q for p, q in zip(a, b))
            return f"{count} rows differ, first {[v for _, v in x]} vs {[v for _, v in y]}"
    return None


def compare(spark: SparkSession, connection, folder: str, name: str) -> tuple[str, int, float]:
    """(verdict, rows, seconds); the verdict is 'ok', 'rows only' or a description of the difference."""
    start = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(row) for row in df.collect()]
    seconds = time.time() - start
    if name not in ORACLE:
        return "rows only", len(rows), seconds
    answer = connection.execute(ORACLE[name])
    expected = answer.fetchall()
    problem = differences(df.columns, rows, [d[0] for d in answer.description], expected)
    return problem or "ok", len(rows), seconds


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, connection = session(), database(folder)
    bad = 0
    for name in names:
        try:
            verdict, rows, seconds = compare(spark, connection, folder, name)
        except Exception as error:
            verdict, rows, seconds = f"error {str(error)[:1500]}", 0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:24s} {rows:7d} rows {seconds:7.2f}s  {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
