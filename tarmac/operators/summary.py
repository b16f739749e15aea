"""Aggregates and reports over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.order import avg_rank, cumulative, null_safe, quantiles  # noqa: F401
from tarmac.sources.stages import staged

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def top_states(df: DataFrame, n: int = 15, min_rows: int = 1000) -> DataFrame:
    """(state, n) of the n states with most rows, of those with min_rows at least; ties by name."""
    return df.where("state is not null").groupBy("state").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).orderBy(F.desc("n"), "state").limit(n)


def missing_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(variable, nulls, share) of each column, in one pass."""
    cols = cols or df.columns
    one = df.agg(F.count("*").alias("__total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot("__total", cols, "variable", "nulls").select("variable", "nulls", F.try_divide(F.col("nulls"), F.col("__total")).alias("share"))


def compare_structure(before: DataFrame, after: DataFrame) -> DataFrame:
    """missing_summary of two tables, with a column stage."""
    return missing_summary(before).withColumn("stage", F.lit("before")).unionByName(missing_summary(after).withColumn("stage", F.lit("after")))


def _long(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), list(cols), "variable", "value")


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    return _long(df, cols).groupBy("variable").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def corrected_skew(c: str) -> Column:
    """Skewness with the correction for the size of the sample; null below 3 values."""
    n = F.count(c)
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2.0) * F.skewness(c))


def corrected_kurtosis(c: str) -> Column:
    """Excess kurtosis with the correction for the size of the sample; null below 4 values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(c) + 6.0))


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row per column: n, mean, sd, quartiles, share of nulls, corrected skewness and kurtosis."""
    long = _long(df, cols)
    stats = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.count_if(F.col("value").isNull()) / F.count("*") * 100).alias("missing_pct"), corrected_skew("value").alias("skew"), corrected_kurtosis("value").alias("kurtosis"),
    )
    return stats.join(quantiles(long, ["variable"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "variable", "left").select("variable", "n", "mean", "sd", "min", "q25", "q50", "q75", "max", "missing_pct", "skew", "kurtosis")


def numeric_stats(df: DataFrame, cols: list[str], by: str | None = None, probs: list[float] | None = None) -> DataFrame:
    """Deciles, shape and numbers of values beyond the 1.5 IQR fences, overall or by group."""
    probs = probs or [i / 10 for i in range(11)]
    ids = [by] if by else []
    long, keys = _long(df, cols, ids), ["variable", *ids]
    names = [f"p{round(p * 100)}" for p in probs]
    moments = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.skewness("value").alias("skew"))
    stats = null_safe(moments, quantiles(long, keys, "value", dict(zip(names, probs, strict=True)) | {"__a": 0.25, "__b": 0.75}), keys, "left")
    lo, hi = (F.col("__a") - 1.5 * (F.col("__b") - F.col("__a")), F.col("__b") + 1.5 * (F.col("__b") - F.col("__a")))
    out = null_safe(long, stats.select(*keys, lo.alias("__lo"), hi.alias("__hi")), keys).groupBy(*keys).agg(F.count_if((F.col("value") < F.col("__lo")) | (F.col("value") > F.col("__hi"))).alias("outliers"))
    return null_safe(stats.select(*keys, "n", "mean", "sd", "skew", *names), out, keys)


def describe_by(df: DataFrame, cols: list[str], by: str, trim: float = 0.1) -> DataFrame:
    """n, mean, sd, median, trimmed mean, mad, min, max, range, skewness, kurtosis, se by group."""
    long = _long(df, cols, [by]).where("value is not null")
    keys = ["variable", by]
    moments = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))
    counts = staged(long.groupBy(*keys, "value").agg(F.count("*").alias("times")), "value-counts")  # all that order and deviations need
    first = null_safe(moments, quantiles(counts, keys, "value", {"median": 0.5, "__lo": trim, "__hi": 1 - trim}, "times"), keys)
    first = staged(first, "moments")
    near = null_safe(counts, first.select(*keys, "median", "__lo", "__hi"), keys)
    inside = F.when(F.col("value").between(F.col("__lo"), F.col("__hi")), F.col("times"))
    second = near.groupBy(*keys).agg((F.sum(inside * F.col("value")) / F.sum(inside)).alias("trimmed"))
    mad = quantiles(near, keys, F.abs(F.col("value") - F.col("median")), {"mad": 0.5}, "times").withColumn("mad", 1.4826 * F.col("mad"))
    return null_safe(null_safe(first, second, keys), mad, keys).select(*keys, "n", "mean", "sd", "median", "trimmed", "mad", "min", "max", (F.col("max") - F.col("min")).alias("range"), "skew", "kurtosis", (F.col("sd") / F.sqrt("n")).alias("se"))


def frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, level, n, share of the variable's non-null rows) of many columns at once."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "level").where("level is not null")
    return long.groupBy("variable", "level").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("variable")))


def rare_modalities(freq: DataFrame, min_n: int = 30, min_share: float = 0.005) -> DataFrame:
    return freq.where((F.col("n") < min_n) | (F.col("share") < min_share))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """(value, n, percent), null among the values."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of the most frequent value; the smallest of ties."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1)


def mode_by(df: DataFrame, key: str, col: str, out: str | None = None) -> DataFrame:
    """(key, most frequent value); the smallest of ties. Counts first, so hot keys are no problem."""
    counts = df.where(F.col(col).isNotNull() & F.col(key).isNotNull()).groupBy(key, col).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(key).orderBy(F.desc("__n"), col)
    return counts.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, F.col(col).alias(out or col))


def modes_by_cluster(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(cluster, variable, level, n): the most frequent levels, with all ties."""
    long = df.select(cluster, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([cluster], cols, "variable", "level").where("level is not null")
    counts = long.groupBy(cluster, "variable", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("__r", F.rank().over(Window.partitionBy(cluster, "variable").orderBy(F.desc("n")))).where("__r = 1").drop("__r")


def kpis(df: DataFrame) -> DataFrame:
    """rows, mean_severity, severe_pct, counties and peak_hour (the earliest of ties)."""
    peak = df.where("start_time is not null").groupBy(F.hour("start_time").alias("h")).count().orderBy(F.desc("count"), "h").limit(1).select(F.col("h").alias("peak_hour"))
    one = df.agg(F.count("*").alias("rows"), F.avg("severity").alias("mean_severity"), F.avg((F.col("severity") >= 3).cast("int")).alias("__s"), F.count_distinct("county").alias("counties"))
    return one.join(F.broadcast(peak), F.lit(True), "left").select("rows", "mean_severity", (F.col("__s") * 100).alias("severe_pct"), "counties", "peak_hour")


def day_hour_pivot(df: DataFrame, agg: Column, ts: str = "start_time") -> DataFrame:
    """A row per day of the week, a column per hour."""
    day = F.date_format(ts, "EEEE")
    wide = df.groupBy(day.alias("day")).pivot("hour", list(range(24))) if "hour" in df.columns else df.withColumn("hour", F.hour(ts)).groupBy(day.alias("day")).pivot("hour", list(range(24)))
    out = wide.agg(agg)
    order = F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col("day"))
    return out.select("day", order.cast("int").alias("day_no"), *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def severity_profile(df: DataFrame, by: str | Column, name: str | None = None, min_rows: int = 1) -> DataFrame:
    """(by, n, mean_severity, severe_pct) of groups with min_rows at least."""
    key = (F.col(by) if isinstance(by, str) else by).alias(name or by)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), (F.avg((F.col("severity") >= 3).cast("int")) * 100).alias("severe_pct")).where(F.col("n") >= min_rows)


def severity_profile_top(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """severity_profile of the n most frequent values; ties to the smaller value."""
    top = df.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(n).select(by)
    return severity_profile(df.join(F.broadcast(top), by, "left_semi"), by)


def infrastructure_profile(df: DataFrame, flags: list[str], labels: dict[bool, str] | None = None) -> DataFrame:
    """severity_profile of several flags, stacked: (variable, status, ...)."""
    labels = labels or {True: "Yes", False: "No"}
    long = df.select("severity", *flags).unpivot(["severity"], flags, "variable", "flag")
    status = F.when(F.col("flag"), labels[True]).otherwise(labels[False])
    return long.groupBy("variable", status.alias("status")).agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), (F.avg((F.col("severity") >= 3).cast("int")) * 100).alias("severe_pct"))


def county_stats(df: DataFrame) -> DataFrame:
    means = {"mean_severity": "severity", "mean_temperature": "temperature_f", "mean_wind": "wind_speed_mph", "mean_precipitation": "precipitation_in", "lat": "start_lat", "lng": "start_lng"}
    return df.groupBy("county").agg(F.count("*").alias("n"), *[F.avg(c).alias(k) for k, c in means.items()])


BAD_WEATHER = ["Light_Rain", "Heavy_Storms", "Snow", "Ice_Sleet_Mix", "Fog_Haze"]


def cell_profile(df: DataFrame, cell: str = "cell") -> DataFrame:
    """Per cell: n, mean_severity, severe_pct, night_pct, bad_weather_pct, dominant_weather, lat, lng."""
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    stats = df.groupBy(cell).agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), pct(F.col("severity") >= 3).alias("severe_pct"), pct(F.coalesce(F.col("sunrise_sunset") == "Night", F.lit(False))).alias("night_pct"), pct(F.coalesce(F.col("weather_group").isin(*BAD_WEATHER), F.lit(False))).alias("bad_weather_pct"), F.avg("start_lat").alias("lat"), F.avg("start_lng").alias("lng"))
    return stats.join(mode_by(df, cell, "weather_group", "dominant_weather"), cell, "left")


def cluster_balance(df: DataFrame, cluster: str) -> DataFrame:
    """Number of clusters, smallest and largest share, imbalance (largest / smallest), min and max size."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.sum("n").alias("total")).select("clusters", "min_n", "max_n", (F.col("min_n") / F.col("total")).alias("min_prop"), (F.col("max_n") / F.col("total")).alias("max_prop"), (F.col("max_n") / F.col("min_n")).alias("imbalance"), (F.col("min_n") / F.col("max_n")).alias("min_max"))


def cluster_numeric_profile(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(cluster, variable, n, pct, mean, sd, median)."""
    total = df.groupBy(cluster).agg(F.count("*").alias("n")).withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
    long, keys = _long(df, cols, [cluster]), [cluster, "variable"]
    stats = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    stats = null_safe(stats, quantiles(long, keys, "value", {"median": 0.5}), keys, "left")
    return stats.join(total, cluster)


def cluster_rates(df: DataFrame, cluster: str, flags: list[str], severity: str = "severity") -> DataFrame:
    """(cluster, severe_rate, and the rate of each flag)."""
    rate = lambda c: F.avg(c.cast("double"))
    return df.groupBy(cluster).agg(rate(F.col(severity) >= 3).alias("severe_rate"), *[rate(F.col(f)).alias(f"{f}_rate") for f in flags])


def cluster_categorical_profile(df: DataFrame, cluster: str, cols: list[str], min_share: float = 0.0) -> DataFrame:
    """(cluster, variable, level, n, share within cluster), shares over min_share."""
    long = df.select(cluster, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([cluster], cols, "variable", "level").where("level is not null")
    counts = long.groupBy(cluster, "variable", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cluster, "variable"))).where(F.col("share") > min_share)


def contingency(df: DataFrame, r: str, c: str) -> DataFrame:
    """(row_cat, col_cat, n, row_share, col_share), zero cells included; nulls left out."""
    counts = df.where(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(F.col(r).cast("string").alias("row_cat"), F.col(c).cast("string").alias("col_cat")).agg(F.count("*").alias("n"))
    full = counts.select("row_cat").distinct().crossJoin(counts.select("col_cat").distinct()).join(counts, ["row_cat", "col_cat"], "left").fillna(0, ["n"])
    return full.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("row_cat"))).withColumn("col_share", F.col("n") / F.sum("n").over(Window.partitionBy("col_cat")))


def cluster_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two clusterings of the same rows against each other, with shares both ways."""
    return contingency(df, a, b)


def radar_frame(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(series, variable, value): the global maximum and minimum and the mean of each cluster."""
    whole = _long(df, cols).groupBy("variable").agg(F.max("value").alias("max"), F.min("value").alias("min")).unpivot(["variable"], ["max", "min"], "series", "value")
    means = _long(df, cols, [cluster]).groupBy("variable", F.concat(F.lit("cluster "), F.col(cluster).cast("string")).alias("series")).agg(F.avg("value").alias("value"))
    return whole.unionByName(means)


def audit(df: DataFrame, cols: list[str], samples: int = 5) -> DataFrame:
    """(variable, type, nulls, levels, samples): the smallest values as text."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "level")
    counts = long.groupBy("variable", "level").agg(F.count("*").alias("n"))
    w = Window.partitionBy("variable").orderBy(F.col("level").asc_nulls_last())
    first = counts.withColumn("__r", F.row_number().over(w))
    out = first.groupBy("variable").agg(F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("level").alias("levels"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("__r") <= samples, F.col("level")))), "|").alias("samples"))
    return out.withColumn("type", F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])[F.col("variable")])


def histogram(df: DataFrame, col: str, bins: int = 45) -> DataFrame:
    """(bin, n): equal bins from minimum to maximum, the maximum in the last one."""
    c = F.col(col).cast("double")
    ends = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(c - F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins), F.lit(0.0)))).cast("int")
    return df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def quantile_of(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """One row of exact quantiles, p50 for 0.5."""
    return quantiles(df, [], col, {f"p{round(p * 100)}": p for p in probs})


def stack(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables; columns that are missing somewhere are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def rows_not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def top_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def critical_zones(cells: DataFrame, cell: str = "cell", min_rows: int = 10, n: int = 5) -> DataFrame:
    """The n cells of the largest severe share, of those with min_rows at least, as Z1, Z2, ...

    Ties by number of rows, then by cell. The window runs over the n rows that are left.
    """
    top = cells.where(F.col("n") >= min_rows).orderBy(F.desc("severe_pct"), F.desc("n"), cell).limit(n)
    w = Window.orderBy(F.desc("severe_pct"), F.desc("n"), cell)
    return top.withColumn("zone", F.concat(F.lit("Z"), F.row_number().over(w).cast("string")))


def best_model(metrics: DataFrame, valid: str = "valid", score: str = "silhouette", tie: str = "k") -> DataFrame:
    """The valid row of the best score, or the best of all where none is valid."""
    return metrics.orderBy(F.col(valid).desc_nulls_last(), F.col(score).desc_nulls_last(), tie).limit(1)


def rank_total(metrics: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """Competition ranks (ties share the smallest) of each metric, and their sum; metrics has a row per model."""
    out = metrics
    for c, by in [(c, F.desc(c)) for c in higher] + [(c, F.asc(c)) for c in lower]:
        out = out.withColumn(f"rank_{c}", F.rank().over(Window.orderBy(by)))
    return out.withColumn("rank_total", reduce(lambda a, b: a + b, [F.col(f"rank_{c}") for c in [*higher, *lower]]))


def with_row_id(df: DataFrame, key: str | None = None, out: str = "row_id") -> DataFrame:
    """A row id: the natural key where there is one, else a number that holds while the plan does."""
    return df.withColumn(out, F.col(key) if key else F.monotonically_increasing_id())


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)
