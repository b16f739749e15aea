"""Queries of row-level operators: cleaning, features and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import clean, features, text
from tarmac.plans.common import I, query, rounded, t
from tarmac.sources import tables
from tarmac.sources.incidents import FLAGS, incidents


def case(expr: str, lists: dict) -> str:
    return "CASE " + " ".join("WHEN {} IN ({}) THEN '{}'".format(expr, ", ".join(f"'{x}'" for x in names), g) for g, names in lists.items()) + " ELSE 'Other' END"


RULES_SQL = """CASE WHEN weather_condition IS NULL THEN NULL WHEN weather_condition IN ('Clear', 'Fair', 'Fair / Windy') THEN 'Clear'
 WHEN regexp_matches(lower(weather_condition), 'cloud|overcast') THEN 'Cloudy'
 WHEN regexp_matches(lower(weather_condition), 'rain|drizzle') AND NOT regexp_matches(lower(weather_condition), 'heavy|storm|thunder') THEN 'Light_Rain'
 WHEN regexp_matches(lower(weather_condition), 'heavy|storm|thunder') THEN 'Heavy_Storms' WHEN regexp_matches(lower(weather_condition), 'snow') THEN 'Snow'
 WHEN regexp_matches(lower(weather_condition), 'ice|sleet|freez|wintry') THEN 'Ice_Sleet_Mix' WHEN regexp_matches(lower(weather_condition), 'fog|haze') THEN 'Fog_Haze' ELSE 'Other' END"""
EXACT_SQL = f"CASE WHEN weather_condition IS NULL THEN NULL ELSE {case('weather_condition', features.WEATHER_LISTS)} END"
WIND_SQL = """CASE WHEN wind_direction IS NULL THEN NULL WHEN wind_direction IN ('Calm', 'CALM') THEN 'Calm' WHEN wind_direction IN ('Var', 'VAR', 'Variable') THEN 'Variable'
 WHEN starts_with(upper(wind_direction), 'N') THEN 'North' WHEN starts_with(upper(wind_direction), 'S') THEN 'South' WHEN starts_with(upper(wind_direction), 'E') THEN 'East' WHEN starts_with(upper(wind_direction), 'W') THEN 'West' ELSE 'Other' END"""
DURATION_SQL = "(epoch_us(end_time) - epoch_us(start_time)) / 3.6e9"
SEASON_SQL = "CASE WHEN month(start_time) IN (12, 1, 2) THEN 'Winter' WHEN month(start_time) IN (3, 4, 5) THEN 'Spring' WHEN month(start_time) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"
TC, WC = "round((temperature_f - 32) * 5 / 9, 1)", "round((wind_chill_f - 32) * 5 / 9, 1)"
INFRA_SQL = "CASE WHEN amenity OR crossing OR give_way OR no_exit OR railway OR station OR stop OR traffic_calming THEN 1 ELSE 0 END"
INFRA10_SQL = "CASE WHEN amenity OR crossing OR give_way OR no_exit OR railway OR station OR stop OR traffic_calming OR junction OR traffic_signal THEN 'Yes' ELSE 'No' END"


@query(f"{I} SELECT id, {RULES_SQL} AS by_rules, {EXACT_SQL} AS by_list, {WIND_SQL} AS wind_group FROM i")
def weather_and_wind_groups(spark, d):
    w = F.col("weather_condition")
    return incidents(spark, d).select("id", features.weather_group(w).alias("by_rules"), features.weather_group(w, "exact").alias("by_list"), features.wind_group(F.col("wind_direction")).alias("wind_group"))


@query(f"{I} SELECT id, {TC} AS temperature_c, {WC} AS wind_chill_c, {INFRA_SQL} AS has_infrastructure, {INFRA10_SQL} AS any_flag FROM i")
def celsius_and_infrastructure(spark, d):
    df = incidents(spark, d)
    return rounded(df.select("id", features.f_to_c(F.col("temperature_f")).alias("temperature_c"), features.f_to_c(F.col("wind_chill_f")).alias("wind_chill_c"), features.has_infrastructure().alias("has_infrastructure"), features.has_infrastructure([*features.INFRASTRUCTURE, "junction", "traffic_signal"], True).alias("any_flag")))


@query(f"""{I} SELECT id, round({DURATION_SQL}, 6) AS duration_hours, round(CASE WHEN {DURATION_SQL} > 0 THEN {DURATION_SQL} END, 6) AS duration_positive,
 round(ln(1 + CASE WHEN {DURATION_SQL} > 0 THEN {DURATION_SQL} END), 6) AS log_duration FROM i""")
def durations(spark, d):
    df = incidents(spark, d).withColumn("duration_hours", features.duration_hours(F.col("start_time"), F.col("end_time")))
    df = df.withColumn("duration_positive", F.col("duration_hours"))
    df = clean.null_nonpositive(df, "duration_positive")
    return rounded(df.select("id", "duration_hours", "duration_positive", F.log1p("duration_positive").alias("log_duration")))


@query(f"""{I} SELECT id, hour(start_time)::INT AS hour, month(start_time)::INT AS month, year(start_time)::INT AS year, start_time::DATE AS date, dayname(start_time) AS day_name, strftime(start_time, '%b') AS month_label,
 isodow(start_time) >= 6 AS weekend, strftime(start_time, '%Y-%m') AS period, {SEASON_SQL} AS season,
 CASE WHEN hour(start_time) BETWEEN 6 AND 11 THEN 'Morning' WHEN hour(start_time) BETWEEN 12 AND 17 THEN 'Afternoon' WHEN hour(start_time) >= 18 THEN 'Evening' ELSE 'Night' END AS quarters,
 CASE WHEN hour(start_time) <= 5 THEN 'Night' WHEN hour(start_time) <= 11 THEN 'Morning' WHEN hour(start_time) <= 17 THEN 'Afternoon' WHEN hour(start_time) <= 21 THEN 'Evening' ELSE 'LateNight' END AS uneven,
 round(sin(2 * pi() * hour(start_time) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(start_time) / 24), 6) + 0.0 AS hour_cos FROM i""")
def time_features(spark, d):
    df = features.time_parts(incidents(spark, d), "start_time")
    s, c = features.cyclic(F.col("hour"), 24)
    ts = F.col("start_time")
    return rounded(df.select("id", "hour", "month", "year", "date", "day_name", "month_label", features.is_weekend(ts).alias("weekend"), features.period_month(ts).alias("period"), features.season(F.col("month")).alias("season"), features.time_period(F.col("hour")).alias("quarters"), features.time_period(F.col("hour"), "uneven").alias("uneven"), s.alias("hour_sin"), c.alias("hour_cos")))


@query(f"""{I} SELECT id, CASE WHEN severity IN (1, 2) THEN 'Low_Moderate' WHEN severity = 3 THEN 'High' ELSE 'Very_High' END AS severity_group, severity >= 3 AS severe, 'S' || severity AS label, severity AS back,
 CASE WHEN temperature_f IS NULL THEN NULL WHEN {TC} < 0 THEN 'Freezing' WHEN {TC} < 10 THEN 'Cold' WHEN {TC} < 25 THEN 'Mild' ELSE 'Warm' END AS temperature,
 CASE WHEN wind_speed_mph = 0 THEN 'Calm' WHEN wind_speed_mph < 10 THEN 'Low_Wind' WHEN wind_speed_mph < 20 THEN 'Moderate_Wind' ELSE 'Strong_Wind' END AS wind,
 CASE WHEN precipitation_in = 0 THEN 'No_Precip' WHEN precipitation_in <= 0.05 THEN 'Light_Precip' ELSE 'Relevant_Precip' END AS precipitation,
 CASE WHEN humidity IS NULL THEN NULL WHEN humidity < 40 THEN 'Low_Humidity' WHEN humidity < 75 THEN 'Medium_Humidity' ELSE 'High_Humidity' END AS humidity,
 CASE WHEN humidity IS NULL THEN NULL WHEN humidity > 84 THEN 'Humid' ELSE 'Normal' END AS humidity_mark,
 CASE WHEN wind_chill_f IS NULL THEN NULL WHEN {WC} < 0 THEN 'Freezing_Chill' WHEN {WC} < 10 THEN 'Cold_Chill' WHEN {WC} < 25 THEN 'Mild_Chill' ELSE 'Warm_Chill' END AS chill,
 CASE WHEN temperature_f IS NULL THEN NULL WHEN {TC} < 5 THEN 'Cold' WHEN {TC} > 25 THEN 'Hot' ELSE 'Mild' END AS temperature_mark,
 CASE WHEN junction THEN 'With' ELSE 'Without' END AS junction, greatest(least(wind_speed_mph, 30), 2) AS clipped FROM i""")
def bins_and_labels(spark, d):
    df = incidents(spark, d)
    s, tc, wc = F.col("severity"), features.f_to_c(F.col("temperature_f")), features.f_to_c(F.col("wind_chill_f"))
    b = features.fixed_bin
    return df.select("id", features.severity_group(s).alias("severity_group"), features.is_severe(s).alias("severe"), features.severity_label(s).alias("label"), features.severity_number(features.severity_label(s)).alias("back"), b(tc, "temperature").alias("temperature"), b(F.col("wind_speed_mph"), "wind_speed").alias("wind"), b(F.col("precipitation_in"), "precipitation").alias("precipitation"), b(F.col("humidity"), "humidity").alias("humidity"), b(F.col("humidity"), "humidity_mark").alias("humidity_mark"), b(wc, "wind_chill").alias("chill"), b(tc, "temperature_mark").alias("temperature_mark"), features.binary_label(F.col("junction"), "Without", "With").alias("junction"), features.clip(F.col("wind_speed_mph"), 2.0, 30.0).alias("clipped"))


@query(f"""{I}, q AS (SELECT quantile_cont(pressure_in, 1/3) AS a, quantile_cont(pressure_in, 2/3) AS b, max(pressure_in) AS c FROM i)
 SELECT id, CASE WHEN pressure_in <= a THEN 'Low_Pressure' WHEN pressure_in <= b THEN 'Medium_Pressure' ELSE 'High_Pressure' END AS pressure_bin FROM i, q""")
def pressure_terciles(spark, d):
    return features.quantile_bin(incidents(spark, d), "pressure_in", [0, 1 / 3, 2 / 3, 1], ["Low_Pressure", "Medium_Pressure", "High_Pressure"], "pressure_bin").select("id", "pressure_bin")


@query(f"""{I}, c AS (SELECT weather_condition AS w, count(*) AS n FROM i WHERE weather_condition IS NOT NULL GROUP BY 1), k AS (SELECT w FROM c WHERE n >= 0.08 * (SELECT sum(n) FROM c)),
 m AS (SELECT w FROM c ORDER BY n DESC, w LIMIT 3)
 SELECT id, CASE WHEN weather_condition IS NULL OR weather_condition IN (SELECT w FROM k) THEN weather_condition ELSE 'Other' END AS common, CASE WHEN weather_condition IS NULL OR weather_condition IN (SELECT w FROM m) THEN weather_condition ELSE 'Other' END AS top3 FROM i""")
def collapsed_levels(spark, d):
    df = incidents(spark, d).select("id", F.col("weather_condition").alias("common"), F.col("weather_condition").alias("top3"))
    return features.collapse_top_n(features.collapse_rare(df, "common", 0.08), "top3", 3).select("id", "common", "top3")


@query(f"{I} SELECT id, city || ' / ' || county || ' County / ' || state AS zone, printf('%.3f', floor(start_lat * 1000 + 0.5) / 1000) || ', ' || printf('%.3f', floor(start_lng * 1000 + 0.5) / 1000) AS place FROM i WHERE start_lat BETWEEN -90 AND 90 AND start_lng BETWEEN -180 AND 180")
def zone_labels(spark, d):
    df = clean.valid_coords(incidents(spark, d))
    none = F.lit(None).cast("string")
    lat, lng = F.col("start_lat"), F.col("start_lng")
    return df.select("id", features.zone_label(F.col("city"), F.col("county"), F.col("state"), lat, lng).alias("zone"), features.zone_label(none, none, none, lat, lng).alias("place"))


@query(f"{I}, m AS (SELECT avg(humidity) AS a, stddev_samp(humidity) AS s, avg(pressure_in) AS b, stddev_samp(pressure_in) AS u FROM i) SELECT id, round((humidity - a) / s, 6) AS z_humidity, round((pressure_in - b) / u, 6) + 0.0 AS z_pressure_in FROM i, m")
def column_zscores(spark, d):
    return rounded(features.zscore(incidents(spark, d), ["humidity", "pressure_in"]).select("id", "z_humidity", "z_pressure_in"))


@query(f"""{I}, m AS (SELECT county, c, avg(n) OVER (PARTITION BY county) AS a, stddev_samp(n) OVER (PARTITION BY county) AS s, n FROM (SELECT county, dayofmonth(start_time) AS c, count(*) AS n FROM i GROUP BY 1, 2))
 SELECT county, c::INT AS day, round((n - a) / s, 6) + 0.0 AS z FROM m WHERE s > 0""")
def series_zscores(spark, d):
    days = incidents(spark, d).groupBy("county", F.dayofmonth("start_time").alias("day")).count()
    return rounded(features.zscore_by(days, "county", "count").select("county", "day", "z"))


@query(f"{I} SELECT id, airport_code FROM i WHERE state = 'S3' AND airport_code IS NOT NULL AND humidity IS NOT NULL")
def one_state_complete_cases(spark, d):
    df = clean.filter_state(incidents(spark, d), "S3")
    return clean.select_available(clean.complete_cases(df, ["airport_code", "humidity"]), ["id", "airport_code", "no_such_column"])


@query(f"{I}, s AS (SELECT state FROM i GROUP BY 1 HAVING count(*) >= 300 ORDER BY count(*) DESC, state LIMIT 15) SELECT id, state FROM i WHERE state IN (SELECT state FROM s)")
def rows_of_chosen_states(spark, d):
    from tarmac.operators.summary import top_states

    df = incidents(spark, d)
    return clean.filter_states(df, top_states(df, 15, 300)).select("id", "state")


@query(f"{I} SELECT count(*) AS before, count(*) FILTER (weather_condition IS NULL OR weather_condition = 'Smoke') AS removed, count(*) FILTER (weather_condition <> 'Smoke') AS after FROM i")
def excluded_category(spark, d):
    return clean.filter_with_summary(incidents(spark, d), F.col("weather_condition") != "Smoke")[1]


@query(f"""{I} SELECT id, coalesce(wind_chill_f > temperature_f, false) OR coalesce(temperature_f - wind_chill_f > 30, false) OR distance_mi > 5 OR precipitation_in > 5 AS one_state,
 coalesce(wind_chill_f > temperature_f, false) OR coalesce(temperature_f - wind_chill_f > 62, false) OR distance_mi > 5 OR precipitation_in > 5 AS one_state_final,
 coalesce({WC} > {TC}, false) OR coalesce({TC} - {WC} > 16.7, false) OR precipitation_in > 5 OR {DURATION_SQL} > 48 AS multistate FROM i""")
def anomaly_rules(spark, d):
    df = incidents(spark, d).withColumns({"temperature_c": features.f_to_c(F.col("temperature_f")), "wind_chill_c": features.f_to_c(F.col("wind_chill_f")), "duration_hours": features.duration_hours(F.col("start_time"), F.col("end_time"))})
    return df.select("id", *[clean.anomaly_rule(p).alias(p) for p in clean.ANOMALIES])


@query(f"{I} SELECT id, TRY_CAST(nullif(trim(airport_code), '') AS DOUBLE) AS code, CASE severity WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE severity::VARCHAR END AS word FROM i")
def casts_and_relabels(spark, d):
    df = clean.blank_to_null(incidents(spark, d))
    return df.select("id", clean.safe_numeric("airport_code").alias("code"), clean.relabel(F.col("severity").cast("string"), {"1": "one", "2": "two"}).alias("word"))


@query(f"{I} SELECT 'kept' AS what, string_agg(c, ',' ORDER BY c) AS cols FROM (SELECT unnest(['amenity', 'crossing', 'junction', 'county', 'pressure_in', 'severity', 'stop', 'traffic_signal']) AS c) WHERE (SELECT count(*) FROM i) > 0")
def constant_and_null_columns(spark, d):
    df = incidents(spark, d).select("severity", "pressure_in", "humidity", "county", *FLAGS)
    df = df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in df.schema])
    kept = clean.drop_null_columns(clean.drop_constant(df, ["severity", "pressure_in", "humidity"], ["county", *FLAGS]))
    return spark.createDataFrame([("kept", ",".join(sorted(kept.columns)))], "what string, cols string")


STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(text.ENGLISH + text.DOMAIN))


def clean_sql(c: str) -> str:
    rep = lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')"
    for p in text.ROADS:
        c = rep(c, rf"(?i)\b{p}[- ]?(\d+)\b", rf"{p.lower()}\1")
    c = f"translate(lower({rep(c, r'(?i)\bexit[\s[:punct:]]*(\d+)\b', r'exit\1')}), '/-', '  ')"
    c = rep(c, "[[:punct:]]", "")
    for digit, word in text.LANES.items():
        c = rep(c, rf"(?i)\b{digit}\b(\s*(?:left|right|center)?\s*lanes?)", rf"{word}\1")
    c = rf"array_to_string(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x NOT IN ({STOP})), ' ')"
    return f"trim({rep(rep(rep(c, r'\b\d+\b', ''), r'\b[a-z]{1,2}\b', ''), r'\s+', ' ')})"


@query(f"{I} SELECT id, {clean_sql('description')} AS cleaned FROM i")
def cleaned_descriptions(spark, d):
    return text.clean_text(incidents(spark, d).select("id", F.col("description").alias("cleaned")), "cleaned", "id")


@query()
def stemmed_descriptions(spark, d):
    return text.clean_text(incidents(spark, d).select("id", F.col("description").alias("cleaned")), "cleaned", "id", True)


@query(f"{I} SELECT id, severity, humidity, state FROM i")
def csv_round_trip(spark, d):
    """Written as CSV stage, read back with the declared schema."""
    from tarmac.sources.stages import stage_path

    path = stage_path(spark, "csv")
    tables.write_stage(incidents(spark, d).select("id", "severity", "humidity", "state"), path, fmt="csv")
    return tables.read_incidents(spark, path, "id string, severity int, humidity double, state string")


@query(f"{I} SELECT 'rows' AS metric, count(*)::VARCHAR AS value FROM i UNION ALL SELECT 'states', count(DISTINCT state)::VARCHAR FROM i UNION ALL SELECT 'max_severity', max(severity)::VARCHAR FROM i")
def summary_report(spark, d):
    return tables.summary(incidents(spark, d), rows=F.count("*"), states=F.count_distinct("state"), max_severity=F.max("severity"))


@query(f"{I} SELECT county, sum((severity = 1)::INT)::BIGINT AS s1, sum((severity = 2)::INT)::BIGINT AS s2, sum((severity = 3)::INT)::BIGINT AS s3, sum((severity = 4)::INT)::BIGINT AS s4 FROM i GROUP BY 1")
def long_to_wide(spark, d):
    counts = incidents(spark, d).groupBy("county", F.concat(F.lit("s"), F.col("severity").cast("string")).alias("s")).count()
    return tables.export_wide(counts, ["county"], "s", "count", ["s1", "s2", "s3", "s4"]).fillna(0)


@query("SELECT l_orderkey, l_linenumber, variable, value FROM lineitem UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))")
def wide_to_long(spark, d):
    return tables.to_long(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(f"{I} SELECT row_id, state, severity, round(start_lat, 6) AS start_lat, round(start_lng, 6) AS start_lng FROM i WHERE start_lat BETWEEN -90 AND 90 AND start_lng BETWEEN -180 AND 180 AND state IS NOT NULL AND severity IS NOT NULL")
def gated_rows(spark, d):
    """Cleaned rows, let through only if no null and no place off the map is left."""
    cols = ["row_id", "state", "severity", "start_lat", "start_lng"]
    df = clean.complete_cases(clean.valid_coords(incidents(spark, d)).select(*cols), cols)
    df = clean.require_no_nulls(df, cols)
    return rounded(clean.require(df, F.col("start_lat").between(-90, 90) & F.col("start_lng").between(-180, 180), "places off the map"))
