"""Runs a query in Spark and its SQL twin in DuckDB and compares whole results."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, Counter(tuple(_plain(v) for v in row) for row in rows)


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = cursor.fetchall()
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_result, duck_result, shown: int = 3) -> str | None:
    names, left = spark_result
    other_names, right = duck_result
    if names != other_names:
        return f"columns {names} against {other_names}"
    if left == right:
        return None
    only_left, only_right = left - right, right - left
    return (
        f"{left.total()} rows against {right.total()}; only in Spark {only_left.total()}: "
        f"{list(only_left)[:shown]}; only in SQL {only_right.total()}: {list(only_right)[:shown]}"
    )
