"""Deterministic samples: rows in the order of an md5 of id and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each group (all, if fewer). Spark prunes each task's groups to n rows before the shuffle."""
    w = Window.partitionBy(by).orderBy("__o", key)
    return df.withColumn("__o", order_of(key, seed)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__o", "__r")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.withColumn("__o", order_of(key, seed)).orderBy("__o", key).limit(n).drop("__o")


def _by_size(df: DataFrame, by: str, want: Column, key: str, seed: int) -> DataFrame:
    """The first `want` (an expression of n and total) rows of each group.

    A share of the 32-bit head of the order is enough to find all but the last few rows, so rows far
    beyond the wanted share don't reach the window.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("__want", want)
    share = F.col("__want") / F.col("n")
    rows = df.join(sizes, by).withColumn("__o", order_of(key, seed))
    head = F.conv(F.substring("__o", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    # of n uniform heads, more than `want` lie below share plus 10 standard deviations and 100 rows
    near = rows.where(head <= share + 10 * F.sqrt(share / F.col("n")) + 100 / F.col("n"))
    w = Window.partitionBy(by).orderBy("__o", key)
    return near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("__want")).drop("n", "total", "__want", "__o", "__r")


def sample_frac_per_group(df: DataFrame, by: str, frac: float, min_n: int, key: str, seed: int = 42) -> DataFrame:
    """min(size, max(min_n, ceil(frac * size))) rows of each group."""
    return _by_size(df, by, F.least(F.col("n"), F.greatest(F.lit(min_n), F.ceil(F.lit(frac) * F.col("n")))), key, seed)


def sample_proportional(df: DataFrame, by: str, target: int, key: str, floor: int = 10, seed: int = 42) -> DataFrame:
    """min(size, max(floor, round(share * target))) rows of each group."""
    return _by_size(df, by, F.least(F.col("n"), F.greatest(F.lit(floor), F.round(F.col("n") / F.col("total") * target))), key, seed)


def top_levels_by_cluster(df: DataFrame, cluster: str, col: str, n: int = 3) -> DataFrame:
    """(cluster, level, n, rank): the n most frequent levels of each cluster, ties to the smaller label."""
    counts = df.where(F.col(col).isNotNull()).groupBy(cluster, F.col(col).alias("level")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "level"))).where(F.col("rank") <= n)
