"""Registered queries: a Spark plan, its columns, and the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]
#: Letters of column types: Spark's and DuckDB's. r is a double rounded to six places on both sides.
TYPES = {"l": ("bigint", "BIGINT"), "s": ("string", "VARCHAR"), "d": ("double", "DOUBLE"), "r": ("double", "DOUBLE"), "t": ("timestamp_ntz", "TIMESTAMP"), "D": ("date", "DATE"), "b": ("boolean", "BOOLEAN")}


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Build] = {}
        self.oracles: dict[str, str] = {}

    def add(self, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
        """Registers a function under its name with ``columns`` ("name:letter ..."); both sides are cast alike."""
        parts = [c.rsplit(":", 1) for c in columns.split()]

        def register(build: Build) -> Build:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                cols = [F.col(n).cast(TYPES[k][0]) for n, k in parts]
                cols = [F.round(c, 6) + F.lit(0.0) if k == "r" else c for c, (_, k) in zip(cols, parts, strict=True)]
                return build(spark, sf_dir).select(*(c.alias(n) for c, (n, _) in zip(cols, parts, strict=True)))

            name = build.__name__
            self.queries[name] = run
            if sql is not None:
                casts = ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" if k == "r" else f"CAST({n} AS {TYPES[k][1]}) AS {n}" for n, k in parts)
                body = sql.strip().rstrip(";")
                self.oracles[name] = f"SELECT {casts} FROM ({body}) AS result"
            return build

        return register

    def alias(self, name: str, of: str) -> None:
        """Registers ``of``, with its SQL, under a second name."""
        self.queries[name] = self.queries[of]
        if of in self.oracles:
            self.oracles[name] = self.oracles[of]
