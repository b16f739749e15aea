"""Helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.sources.incidents import incidents_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
I = incidents_sql()  # noqa: E741


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, -0.0 as 0.0."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL twin where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
