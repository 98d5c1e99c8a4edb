"""Spark results against DuckDB results of the same query."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str):
    connection = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def spark_rows(frame):
    return canonical(frame.columns, frame.collect())


def duckdb_rows(connection, sql: str):
    relation = connection.sql(sql)
    return canonical(relation.columns, relation.fetchall())


def canonical(columns, rows):
    """Columns by name, rows as sorted tuples."""
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in places], sorted((tuple(_cell(row[i]) for i in places) for row in rows), key=repr)


def _cell(value):
    if isinstance(value, float):
        return None if pd.isna(value) else round(value, 9)
    return tuple(value) if isinstance(value, list) else value
