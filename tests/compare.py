"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df) -> tuple[list[tuple[str, str]], Counter]:
    names = sorted(df.columns)
    types = [(n, dict(df.dtypes)[n]) for n in names]
    return types, Counter(tuple(row[n] for n in names) for row in df.collect())


_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}


def duck_rows(con, sql: str) -> tuple[list[tuple[str, str]], Counter]:
    result = con.sql(sql)
    names = sorted(result.columns)
    kinds = {c: str(t) for c, t in zip(result.columns, result.types)}
    index = [result.columns.index(n) for n in names]
    rows = Counter(tuple(row[i] for i in index) for row in result.fetchall())
    return [(n, _TYPES.get(kinds[n], kinds[n])) for n in names], rows
