"""Rows of a Spark result and of DuckDB SQL, made comparable."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(canonical, value)) if isinstance(value, list | tuple) else value


def agree(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    cols = sorted(df.columns)
    ours = sorted((tuple(map(canonical, r)) for r in df.select(*cols).collect()), key=repr)
    theirs = sorted((tuple(map(canonical, r)) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert ours == theirs
