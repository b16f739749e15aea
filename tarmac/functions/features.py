"""Derived columns of incident records, as column functions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.order import quantiles

CLEAR = ("Clear", "Fair", "Fair / Windy")
#: Weather conditions by group; the rules are tried in this order.
WEATHER_RULES = [
    ("cloud|overcast", None, "Cloudy"), ("rain|drizzle", "heavy|storm|thunder", "Light_Rain"), ("heavy|storm|thunder", None, "Heavy_Storms"),
    ("snow", None, "Snow"), ("ice|sleet|freez|wintry", None, "Ice_Sleet_Mix"), ("fog|haze", None, "Fog_Haze"),
]
WEATHER_LISTS = {
    "Clear": list(CLEAR),
    "Cloudy": ["Cloudy", "Partly Cloudy", "Scattered Clouds", "Mostly Cloudy", "Overcast", "Mostly Cloudy / Windy", "Cloudy / Windy", "Partly Cloudy / Windy"],
    "Light_Rain": ["Rain", "Light Rain", "Light Drizzle", "Drizzle", "Light Rain / Windy", "Rain / Windy"],
    "Heavy_Storms": ["Heavy Rain", "Heavy Rain / Windy", "Heavy Drizzle", "Thunderstorms and Rain", "Thunder", "T-Storm", "Thunder in the Vicinity", "Thunderstorm", "Heavy T-Storm / Windy", "Heavy T-Storm", "Light Thunderstorms and Rain", "Thunder / Windy", "Heavy Thunderstorms and Rain", "Thunder and Hail", "Light Rain with Thunder"],
    "Snow": ["Snow", "Light Snow", "Heavy Snow", "Snow / Windy", "Blowing Snow", "Light Snow / Windy"],
    "Ice_Sleet_Mix": ["Light Freezing Drizzle", "Wintry Mix", "Snow and Sleet", "Light Snow and Sleet", "Light Freezing Rain", "Ice Pellets", "Light Snow and Sleet / Windy", "Snow and Sleet / Windy", "Light Sleet"],
    "Fog_Haze": ["Fog", "Haze", "Shallow Fog", "Patches of Fog", "Drizzle and Fog", "Haze / Windy"],
}
INFRASTRUCTURE = ["amenity", "crossing", "give_way", "no_exit", "railway", "station", "stop", "traffic_calming"]


def _chain(cases: list[tuple[Column, str]], otherwise: str | None) -> Column:
    out = F.lit(otherwise)
    for cond, label in reversed(cases):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def weather_group(c: Column, mode: str = "rules") -> Column:
    """Weather condition by ordered substring rules, or by exact lists; null stays null."""
    if mode == "exact":
        cases = [(c.isin(*names), group) for group, names in WEATHER_LISTS.items()]
    else:
        low = F.lower(c)
        cases = [(c.isin(*CLEAR), "Clear")] + [(low.rlike(has) & ~low.rlike(hasnt) if hasnt else low.rlike(has), group) for has, hasnt, group in WEATHER_RULES]
    return F.when(c.isNotNull(), _chain(cases, "Other"))


def wind_group(c: Column) -> Column:
    up = F.upper(c)
    cases = [(c.isin("Calm", "CALM"), "Calm"), (c.isin("Var", "VAR", "Variable"), "Variable")] + [(up.startswith(x[0]), x) for x in ("North", "South", "East", "West")]
    return F.when(c.isNotNull(), _chain(cases, "Other"))


def f_to_c(c: Column) -> Column:
    """Celsius to one decimal, halves away from zero."""
    return F.round((c - 32) * 5 / 9, 1)


def _true(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def has_infrastructure(flags: list[str] | None = None, as_text: bool = False) -> Column:
    """Whether any flag holds, as 0/1, or as Yes/No."""
    some = reduce(lambda a, b: a | b, [_true(F.col(f)) for f in flags or INFRASTRUCTURE])
    return F.when(some, "Yes").otherwise("No") if as_text else some.cast("int")


TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm", "yyyy-MM-dd")


def parse_ts(c: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """The first format that fits, or null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def duration_hours(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def time_parts(df: DataFrame, ts: str) -> DataFrame:
    """hour, month, year, date, day_name and month_label of a timestamp."""
    c = F.col(ts)
    return df.withColumns({"hour": F.hour(c), "month": F.month(c), "year": F.year(c), "date": F.to_date(c), "day_name": F.date_format(c, "EEEE"), "month_label": F.date_format(c, "MMM")})


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def period_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


#: Fixed values here and in season: hours of the day and months by name.
def time_period(hour: Column, scheme: str = "quarters") -> Column:
    """quarters: 6, 12, 18, 24; uneven: up to 5, 11, 17, 21, later."""
    if scheme == "quarters":
        cases = [((hour >= a) & (hour < a + 6), label) for a, label in ((6, "Morning"), (12, "Afternoon"), (18, "Evening"))]
        return F.when(hour.isNotNull(), _chain(cases, "Night"))
    cases = [(hour <= top, label) for top, label in ((5, "Night"), (11, "Morning"), (17, "Afternoon"), (21, "Evening"))]
    return F.when(hour.isNotNull(), _chain(cases, "LateNight"))


def season(month: Column) -> Column:
    return _chain([(month.isin(*m), s) for m, s in (((12, 1, 2), "Winter"), ((3, 4, 5), "Spring"), ((6, 7, 8), "Summer"), ((9, 10, 11), "Autumn"))], None)


def severity_group(c: Column) -> Column:
    return F.when(c.isNotNull(), _chain([(c.isin(1, 2), "Low_Moderate"), (c == 3, "High")], "Very_High"))


def is_severe(c: Column) -> Column:
    return c >= 3


#: Bins as (upper limit, whether it is included, label), then the label above.
BINS = {
    "temperature": ([(0, False, "Freezing"), (10, False, "Cold"), (25, False, "Mild")], "Warm"),
    "wind_chill": ([(0, False, "Freezing_Chill"), (10, False, "Cold_Chill"), (25, False, "Mild_Chill")], "Warm_Chill"),
    "wind_speed": ([(0, True, "Calm"), (10, False, "Low_Wind"), (20, False, "Moderate_Wind")], "Strong_Wind"),
    "precipitation": ([(0, True, "No_Precip"), (0.05, True, "Light_Precip")], "Relevant_Precip"),
    "humidity": ([(40, False, "Low_Humidity"), (75, False, "Medium_Humidity")], "High_Humidity"),
    "humidity_mark": ([(84, True, "Normal")], "Humid"),
    "temperature_mark": ([(5, False, "Cold"), (25, True, "Mild")], "Hot"),
}


def fixed_bin(c: Column, name: str) -> Column:
    limits, above = BINS[name]
    return F.when(c.isNotNull(), _chain([(c <= top if closed else c < top, label) for top, closed, label in limits], above))


def quantile_bin(df: DataFrame, col: str, probs: list[float], labels: list[str], out: str) -> DataFrame:
    """Bins between quantiles of the whole column: right-closed, the lowest value included."""
    cut = quantiles(df, [], col, {f"__q{i}": p for i, p in enumerate(probs)})
    c = F.col(col)
    cases = [(c <= F.col(f"__q{i + 1}"), label) for i, label in enumerate(labels)]
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.when(c.isNotNull(), _chain(cases, None))).drop(*cut.columns)


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    return F.sin(c * (2 * math.pi / period)), F.cos(c * (2 * math.pi / period))


def binary_label(c: Column, no: str, yes: str) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("false", "f", "0", "no", "n"), no).when(low.isin("true", "t", "1", "yes", "y"), yes)


def severity_label(c: Column) -> Column:
    return F.concat(F.lit("S"), c.cast("string"))


def severity_number(c: Column) -> Column:
    return F.regexp_replace(c, "^S", "").try_cast("int")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Between the limits; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


#: Limits and names of the levels.
def vtest_level(c: Column) -> Column:
    """Traffic-light level of a v-test."""
    return _chain([(c <= -4, "Muy bajo"), (c < -1.96, "Bajo"), (c <= 1.96, "Neutro"), (c < 4, "Alto")], "Muy alto")


#: Semantic blocks of variables, in order.
BLOCKS = [
    ("humidity|pressure|wind_speed|precipitation|weather_group|wind_group|temperature|wind_chill", "1. Meteorologia"),
    ("start_lat|start_lng|county|state|has_infrastructure", "2. Geografia y Via"),
    ("sunrise_sunset|duration|start_hour|start_month|is_weekend|time_period|season", "3. Temporalidad"),
    ("severity", "4. Gravedad e Impacto"),
]


def semantic_group(c: Column) -> Column:
    return _chain([(F.lower(c).rlike(p), g) for p, g in BLOCKS], "5. Otras")


def collapse_rare(df: DataFrame, col: str, min_prop: float = 0.01, other: str = "Other") -> DataFrame:
    """Levels rarer than min_prop of the non-null rows become `other`.

    Levels are counted with partial aggregates; the list of levels that stay has 1/min_prop at most.
    """
    total = df.agg(F.count(col).alias("__total"))
    keep = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__n")).crossJoin(F.broadcast(total)).where(F.col("__n") >= min_prop * F.col("__total")).select(F.col(col).alias("__level"))
    return df.join(F.broadcast(keep), F.col(col) == F.col("__level"), "left").withColumn(col, F.when(F.col(col).isNull() | F.col("__level").isNotNull(), F.col(col)).otherwise(other)).drop("__level")


def collapse_top_n(df: DataFrame, col: str, n: int, other: str = "Other") -> DataFrame:
    """The n most frequent levels stay, ties to the smaller label."""
    keep = df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(n).select(F.col(col).alias("__level"))
    return df.join(F.broadcast(keep), F.col(col) == F.col("__level"), "left").withColumn(col, F.when(F.col(col).isNull() | F.col("__level").isNotNull(), F.col(col)).otherwise(other)).drop("__level")


def zone_label(city: Column, county: Column, state: Column, lat: Column, lng: Column) -> Column:
    """city / county County / state, or rounded coordinates where none is known."""
    named = F.concat_ws(" / ", city, F.concat(county, F.lit(" County")), state)
    return F.when(named != "", named).otherwise(F.concat_ws(", ", *[F.format_string("%.3f", F.floor(x * 1000 + 0.5) / 1000) for x in (lat, lng)]))


def zscore(df: DataFrame, cols: list[str], prefix: str = "z_") -> DataFrame:
    """Standardised by sample moments of the whole table; null where the deviation is 0."""
    m = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
    return df.crossJoin(F.broadcast(m)).withColumns({f"{prefix}{c}": F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in cols}).drop(*m.columns)


def zscore_by(df: DataFrame, key: str, col: str, out: str = "z") -> DataFrame:
    """Standardised within each series; series of zero variance are dropped."""
    w = Window.partitionBy(key)
    sd = F.stddev_samp(col).over(w)
    return df.withColumn("__m", F.avg(col).over(w)).withColumn("__s", sd).where("__s > 0").withColumn(out, (F.col(col) - F.col("__m")) / F.col("__s")).drop("__m", "__s")
