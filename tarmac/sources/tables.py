"""Reading raw files and stage tables, and writing results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULLS = ("", "NA", "NaN")


def read_incidents(spark: SparkSession, path: str | list[str], schema: str, nulls: tuple[str, ...] = NULLS) -> DataFrame:
    """CSV files with a header as `schema`; any of `nulls`, trimmed, is null, and so is what can't be cast.

    Values are read as text and cast by column, so files in any number split without inference.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = snake_columns(spark.read.option("header", True).option("multiLine", False).csv(path))
    cols = []
    for f in wanted.fields:
        if f.name in raw.columns:
            c = F.trim(F.col(f.name))
            c = F.when(~c.isin(*nulls), c)
            if isinstance(f.dataType, T.BooleanType):
                c = F.when(F.lower(c).isin("true", "1", "yes", "t"), True).when(F.lower(c).isin("false", "0", "no", "f"), False)
            else:
                c = c.try_cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """A stage table as Parquet, or as CSV with a header."""
    w = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def write_profiles(long_df: DataFrame, path: str) -> None:
    """One long table of profiles, a folder per k and variable."""
    long_df.write.mode("overwrite").partitionBy("k", "variable").parquet(path)


def snake_columns(df: DataFrame) -> DataFrame:
    """Column names in snake case: Temperature.F. and Temperature(F) become temperature_f."""
    return df.toDF(*[re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower())).strip("_") or "c" for c in df.columns])


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """One column per entry of `names`, which is given so that no pass looks for them."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value))


def export_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list, transposed: bool = False, id_values: list | None = None) -> DataFrame:
    """A long table as one row per id and one column per name, or the other way round."""
    if not transposed:
        return to_wide(df, ids, name, value, names)
    return df.groupBy(name).pivot(ids[0], id_values).agg(F.first(value))


def summary(df: DataFrame, **metrics) -> DataFrame:
    """(metric, value as text) of named aggregates, in one pass."""
    one = df.agg(*[c.cast("string").alias(k) for k, c in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value")


def save_axes(axes: DataFrame, path: str) -> None:
    """Fitted axes, centres or assignments as Parquet."""
    axes.write.mode("overwrite").parquet(path)
