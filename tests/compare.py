"""Compare a Spark result with a DuckDB result: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(plain(record[i]) for i in order) for record in records]
    return [columns[i] for i in order], sorted(keyed, key=repr)


def spark_rows(df):
    return rows(df.columns, df.collect())


def duckdb_rows(connection, statement):
    result = connection.execute(statement)
    return rows([column[0] for column in result.description], result.fetchall())


def spark_types(df):
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    return sorted((column, names.get(kind, kind)) for column, kind in df.dtypes)


def duckdb_types(connection, statement):
    return sorted((row[0], row[1]) for row in connection.execute(f"DESCRIBE {statement}").fetchall())
