"""Column choice, null handling and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_available(df: DataFrame, cols: list[str]) -> DataFrame:
    """Those of `cols` that exist."""
    return df.select(*[c for c in cols if c in df.columns])


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Blank text is null, in every text column."""
    return df.select(*[F.when(F.trim(F.col(f.name)) != "", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def filter_state(df: DataFrame, state: str) -> DataFrame:
    return df.where(F.col("state") == state)


def filter_states(df: DataFrame, states: DataFrame) -> DataFrame:
    """Rows whose state is in `states`; a list of states, which has a row per state at most."""
    return df.join(states.select("state").distinct(), "state", "left_semi")


def valid_coords(df: DataFrame, lat: str = "start_lat", lng: str = "start_lng") -> DataFrame:
    return df.where(F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def null_nonpositive(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) > 0, F.col(col)))


def filter_with_summary(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy `cond`, and (before, removed, after). A null condition removes."""
    ok = F.coalesce(cond, F.lit(False))
    return df.where(ok), df.agg(F.count("*").alias("before"), F.count_if(~ok).alias("removed"), F.count_if(ok).alias("after"))


#: Limits of each preset. Wind chill above temperature is always anomalous.
ANOMALIES = {
    "one_state": {"distance_mi": 5, "drop_f": 30, "precipitation_in": 5},
    "one_state_final": {"distance_mi": 5, "drop_f": 62, "precipitation_in": 5},
    "multistate": {"drop_c": 16.7, "precipitation_in": 5, "duration_hours": 48},
}


def anomaly_rule(preset: str) -> Column:
    """Whether a row breaks a domain rule; a comparison with null doesn't."""
    p = ANOMALIES[preset]
    t, w = ("temperature_c", "wind_chill_c") if "drop_c" in p else ("temperature_f", "wind_chill_f")
    rules = [F.col(w) > F.col(t), F.col(t) - F.col(w) > p.get("drop_c", p.get("drop_f"))]
    rules += [F.col(c) > p[c] for c in ("distance_mi", "precipitation_in", "duration_hours") if c in p]
    return reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules])


def safe_numeric(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")


def drop_constant(df: DataFrame, num: list[str], cat: list[str]) -> DataFrame:
    """Without numeric columns of zero (or no) variance and text columns of fewer than two levels; one pass."""
    got = df.agg(*[F.stddev_samp(c).alias(c) for c in num], *[F.size(F.array_distinct(F.array(F.min(c), F.max(c)))).alias(c) for c in cat], *[F.count(c).alias(f"n__{c}") for c in cat]).first()
    gone = [c for c in num if not got[c]] + [c for c in cat if got[c] < 2 or not got[f"n__{c}"]]
    return df.drop(*gone)


def drop_null_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Without those of `cols` (all) that hold a null; one pass."""
    cols = cols or df.columns
    got = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if got[c]])


def require(df: DataFrame, cond: Column, message: str) -> DataFrame:
    """`df`, or an error that names how many rows don't satisfy `cond`."""
    bad = df.where(~F.coalesce(cond, F.lit(False))).count()
    if bad:
        raise ValueError(f"{message}: {bad} rows")
    return df


def require_no_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    got = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    if any(got.values()):
        raise ValueError(f"nulls remain: { {c: n for c, n in got.items() if n} }")
    return df


def relabel(c: Column, mapping: dict) -> Column:
    """The mapped value, or the value itself."""
    named = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(named[c], c)


def drop_empty_docs(docs: DataFrame, dtm: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that have a term left."""
    return docs.join(dtm.select(key).distinct(), key, "left_semi")
