"""Joins of the analysis jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.summary import mode_by


def attach_votes(df: DataFrame, votes: DataFrame, key: str = "row_id") -> DataFrame:
    """Votes by row; none is 0."""
    names = [c for c in votes.columns if c != key]
    return df.join(votes, key, "left").fillna(0, names)


def remove_rows(df: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `df` whose key isn't in `bad`; a key with a null is never removed."""
    return df.join(bad.select(*on).distinct(), on, "left_anti")


def keep_variables(vt: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    return vt.join(chosen.select(*on).distinct(), on, "left_semi")


def complete_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """All combinations of two short lists (clusters and variables)."""
    return a.crossJoin(b)


def attach_clusters(df: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(labels, key)


def attach_zone_names(zones: DataFrame, rows: DataFrame, cell: str, cols: list[str]) -> DataFrame:
    """The most common value of each of `cols` in each zone's cell."""
    few = rows.join(zones.select(cell), cell, "left_semi")
    return reduce(lambda z, c: z.join(mode_by(few, cell, c), cell, "left"), cols, zones)


def pairs(df: DataFrame, key: str) -> DataFrame:
    """All pairs of series with the smaller key first; df has a row per series."""
    a, b = (df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns]) for s in "ij")
    return a.join(b, F.col(f"{key}_i") < F.col(f"{key}_j"))


def centroid_distances(a: DataFrame, b: DataFrame, ka: str, kb: str, cols: list[str]) -> DataFrame:
    """Distances between two short lists of centres, ranked for each of the first; equal names are skipped."""
    other = b.select(kb, *[F.col(c).alias(f"__{c}") for c in cols])
    d = F.sqrt(reduce(lambda x, y: x + y, [(F.col(c) - F.col(f"__{c}")) ** 2 for c in cols]))
    out = a.crossJoin(other).where(F.col(ka) != F.col(kb)).withColumn("distance", d).drop(*[f"__{c}" for c in cols])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(ka).orderBy("distance", kb)))
