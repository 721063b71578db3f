"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

from __future__ import annotations

from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(value(row[i]) for i in order)) for row in rows)


def of_frame(df) -> list[str]:
    return normal(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = con.execute(sql)
    return normal([d[0] for d in result.description], result.fetchall())
