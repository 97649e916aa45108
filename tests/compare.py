"""Compare a Spark result with a DuckDB result, regardless of row and column order."""

from __future__ import annotations

import math

import duckdb

from workloads.tables import BASE


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def normalised(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def spark_result(df):
    return normalised(df.columns, [tuple(row) for row in df.collect()])


def duck_result(connection, sql):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return normalised(columns, result.fetchall())


DUCK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def duck_types(connection, sql) -> dict[str, str]:
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    return {d[0]: DUCK_TYPES.get(d[1], d[1]) for d in described}
