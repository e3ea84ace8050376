"""Run a query and its oracle side by side."""

from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(value):
        return "NULL" if value is None or value is pd.NaT else repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def difference(found: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when rows, names and values agree, else what differs."""
    wanted = connection.execute(sql)
    names = [d[0] for d in wanted.description]
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} against {sorted(names)}"
    left = _rows(found.columns, [tuple(r) for r in found.collect()])
    right = _rows(names, wanted.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference in {sorted(names)}:\n  {a}\n  {b}"
    return None
