"""Queries of aggregates, samples, rankings and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import features
from tarmac.operators import sampling, summary
from tarmac.operators import joins
from tarmac.plans.common import I, query, rounded, t
from tarmac.plans.rows import RULES_SQL
from tarmac.sources.incidents import incidents

NUM = ["humidity", "pressure_in", "temperature_f", "wind_speed_mph"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS variable, county, {c} AS value FROM i" for c in NUM)
PROFILE = "count(*) AS n, round(avg(severity), 6) AS mean_severity, round(avg((severity >= 3)::INT) * 100, 6) AS severe_pct"
HEX_SQL = """(SELECT *, concat(cast(CASE WHEN dr > dp AND dr > ds THEN -(rp + rs) ELSE rr END AS bigint), '_', cast(CASE WHEN dr > dp AND dr > ds THEN rp WHEN dp > ds THEN -(rr + rs) ELSE rp END AS bigint)) AS cell
 FROM (SELECT *, abs(rr - q) AS dr, abs(rp - p) AS dp, abs(rs - s) AS ds FROM (SELECT *, floor(q + 0.5) AS rr, floor(p + 0.5) AS rp, floor(s + 0.5) AS rs FROM
 (SELECT *, -q - p AS s FROM (SELECT *, (sqrt(3.0::DOUBLE) / 3 * x - y / 3) / 5.0::DOUBLE AS q, (2.0::DOUBLE / 3 * y) / 5.0::DOUBLE AS p FROM
 (SELECT *, (start_lng + 75) * 111.32::DOUBLE * cos(radians(40.5::DOUBLE)) AS x, (start_lat - 40.5) * 110.574::DOUBLE AS y FROM i WHERE start_lat BETWEEN -90 AND 90 AND start_lng BETWEEN -180 AND 180) a) b) c) d) e)"""


@query(f"{I} SELECT state, count(*) AS n FROM i WHERE state IS NOT NULL GROUP BY 1 HAVING count(*) >= 300 ORDER BY n DESC, state LIMIT 15")
def top_states(spark, d):
    return summary.top_states(incidents(spark, d), 15, 300)


@query(f"{I} SELECT v AS variable, n::BIGINT AS nulls, round(n / total, 6) AS share FROM (SELECT count(*) AS total, count(*) FILTER (humidity IS NULL) AS a, count(*) FILTER (airport_code IS NULL) AS b, count(*) FILTER (state IS NULL) AS c FROM i) CROSS JOIN LATERAL (VALUES ('humidity', a), ('airport_code', b), ('state', c)) x(v, n)")
def missing_values(spark, d):
    return rounded(summary.missing_summary(incidents(spark, d), ["humidity", "airport_code", "state"]))


@query(f"""{I} SELECT stage, 'humidity' AS variable, n AS nulls, round(n / total, 6) AS share FROM (SELECT 'before' AS stage, count(*) FILTER (humidity IS NULL) AS n, count(*) AS total FROM i UNION ALL SELECT 'after', count(*) FILTER (humidity IS NULL), count(*) FROM i WHERE humidity IS NOT NULL)""")
def structure_before_and_after(spark, d):
    df = incidents(spark, d).select("humidity")
    return rounded(summary.compare_structure(df, df.dropna()))


@query(f"{I} SELECT variable, min(value) AS min, max(value) AS max FROM ({LONG}) GROUP BY 1")
def minima_and_maxima(spark, d):
    return summary.min_max(incidents(spark, d), NUM)


@query(f"""{I} SELECT variable, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max,
 round(count(*) FILTER (value IS NULL) / count(*) * 100, 6) AS missing_pct, round(skewness(value), 4) + 0.0 AS skew, round(kurtosis(value), 4) AS kurtosis FROM ({LONG}) GROUP BY 1""")
def numeric_description(spark, d):
    return rounded(summary.describe_numeric(incidents(spark, d), NUM).withColumns({"skew": F.round("skew", 4), "kurtosis": F.round("kurtosis", 4)}))


@query(f"""{I}, l AS (SELECT variable, value FROM ({LONG})), q AS (SELECT variable, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM l GROUP BY 1)
 SELECT variable, count(value) AS n, {', '.join(f'round(quantile_cont(value, {p / 10}), 6) AS p{p * 10}' for p in range(11))}, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers FROM l JOIN q USING (variable) GROUP BY variable""")
def deciles_and_outliers(spark, d):
    return rounded(summary.numeric_stats(incidents(spark, d), NUM).drop("mean", "sd", "skew"))


@query(f"""{I}, l AS (SELECT variable, county, value FROM ({LONG}) WHERE value IS NOT NULL), q AS (SELECT variable, county, median(value) AS m, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM l GROUP BY ALL)
 SELECT variable, county, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(any_value(m), 6) AS median, round(avg(value) FILTER (value BETWEEN lo AND hi), 6) AS trimmed, round(1.4826 * median(abs(value - m)), 6) AS mad, round(max(value) - min(value), 6) AS range, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM l JOIN q USING (variable, county) GROUP BY ALL""")
def description_by_group(spark, d):
    return rounded(summary.describe_by(incidents(spark, d), NUM, "county").drop("min", "max", "skew", "kurtosis"))


@query(f"""{I}, l AS (SELECT variable, level, count(*) AS n FROM (SELECT 'state' AS variable, state AS level FROM i UNION ALL SELECT 'weather', weather_condition FROM i UNION ALL SELECT 'sunrise_sunset', sunrise_sunset FROM i) WHERE level IS NOT NULL GROUP BY ALL)
 SELECT variable, level, n, round(n / sum(n) OVER (PARTITION BY variable), 6) AS share FROM l""")
def category_frequencies(spark, d):
    return rounded(summary.frequencies(incidents(spark, d).withColumnRenamed("weather_condition", "weather"), ["state", "weather", "sunrise_sunset"]))


@query(f"{I}, l AS (SELECT city AS level, count(*) AS n FROM i GROUP BY 1), s AS (SELECT level, n, n / sum(n) OVER () AS share FROM l) SELECT 'city' AS variable, level, n, round(share, 6) AS share FROM s WHERE n < 30 OR share < 0.02")
def rare_levels(spark, d):
    return rounded(summary.rare_modalities(summary.frequencies(incidents(spark, d), ["city"]), 30, 0.02))


@query(f"{I} SELECT sunrise_sunset AS value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent FROM i GROUP BY 1")
def value_distribution(spark, d):
    return rounded(summary.distribution(incidents(spark, d), "sunrise_sunset"))


@query(f"{I} SELECT count(*) AS rows, round(avg(severity), 6) AS mean_severity, round(avg((severity >= 3)::INT) * 100, 6) AS severe_pct, count(DISTINCT county) AS counties, (SELECT hour(start_time)::INT FROM i GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour FROM i")
def dashboard_kpis(spark, d):
    return rounded(summary.kpis(incidents(spark, d)))


@query(f"{I} SELECT dayname(start_time) AS day, isodow(start_time)::INT AS day_no, {', '.join(f'count(*) FILTER (hour(start_time) = {h}) AS h{h}' for h in range(24))} FROM i GROUP BY 1, 2")
def day_hour_counts(spark, d):
    return summary.day_hour_pivot(incidents(spark, d), F.count(F.lit(1))).fillna(0)


@query(f"{I} SELECT dayname(start_time) AS day, isodow(start_time)::INT AS day_no, {', '.join(f'round(avg(severity) FILTER (hour(start_time) = {h}), 6) AS h{h}' for h in range(24))} FROM i GROUP BY 1, 2")
def day_hour_severity(spark, d):
    return rounded(summary.day_hour_pivot(incidents(spark, d), F.avg("severity")))


@query(f"{I} SELECT hour(start_time)::INT AS hour, {PROFILE} FROM i GROUP BY 1")
def severity_by_hour(spark, d):
    return rounded(summary.severity_profile(incidents(spark, d), F.hour("start_time"), "hour"))


@query(f"{I} SELECT city, {PROFILE} FROM i GROUP BY 1 HAVING count(*) >= 190")
def severity_by_large_city(spark, d):
    return rounded(summary.severity_profile(incidents(spark, d), "city", min_rows=190))


@query(f"{I} SELECT weather_condition, {PROFILE} FROM i WHERE weather_condition IN (SELECT weather_condition FROM i WHERE weather_condition IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) GROUP BY 1")
def severity_by_top_weather(spark, d):
    return rounded(summary.severity_profile_top(incidents(spark, d), "weather_condition", 5))


@query(f"{I} SELECT variable, CASE WHEN flag THEN 'Yes' ELSE 'No' END AS status, {PROFILE} FROM (SELECT severity, variable, flag FROM i UNPIVOT (flag FOR variable IN (junction, crossing, stop, traffic_signal))) GROUP BY 1, 2")
def severity_by_infrastructure(spark, d):
    return rounded(summary.infrastructure_profile(incidents(spark, d), ["junction", "crossing", "stop", "traffic_signal"]))


@query(f"{I} SELECT county, count(*) AS n, round(avg(severity), 6) AS mean_severity, round(avg(temperature_f), 6) AS mean_temperature, round(avg(wind_speed_mph), 6) AS mean_wind, round(avg(precipitation_in), 6) AS mean_precipitation, round(avg(start_lat), 6) AS lat, round(avg(start_lng), 6) AS lng FROM i GROUP BY 1 ORDER BY n DESC, county LIMIT 20")
def largest_counties(spark, d):
    return rounded(summary.top_n(summary.county_stats(incidents(spark, d)), "n", 20, "county"))


def cells(spark, d):
    from tarmac.operators.spatial import hex_cell
    from tarmac.functions.clean import valid_coords

    df = valid_coords(incidents(spark, d)).withColumn("weather_group", features.weather_group(F.col("weather_condition")))
    return df.withColumn("cell", hex_cell(F.col("start_lat"), F.col("start_lng")))


CELLS_SQL = f"""{I}, h AS (SELECT *, {RULES_SQL} AS weather_group FROM {HEX_SQL}), g AS (SELECT cell, count(*) AS n, avg(severity) AS mean_severity, avg((severity >= 3)::INT) * 100 AS severe_pct, avg(coalesce(sunrise_sunset = 'Night', false)::INT) * 100 AS night_pct,
 avg(coalesce(weather_group IN ('Light_Rain', 'Heavy_Storms', 'Snow', 'Ice_Sleet_Mix', 'Fog_Haze'), false)::INT) * 100 AS bad_weather_pct, avg(start_lat) AS lat, avg(start_lng) AS lng FROM h GROUP BY 1),
 w AS (SELECT cell, weather_group AS dominant_weather FROM (SELECT cell, weather_group, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, weather_group) AS r FROM h WHERE weather_group IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""
CELL_COLS = "cell, n, round(mean_severity, 6) AS mean_severity, round(severe_pct, 6) AS severe_pct, round(night_pct, 6) AS night_pct, round(bad_weather_pct, 6) AS bad_weather_pct, round(lat, 6) AS lat, round(lng, 6) AS lng, dominant_weather"


@query(f"{CELLS_SQL} SELECT {CELL_COLS} FROM g LEFT JOIN w USING (cell)")
def cell_profiles(spark, d):
    return rounded(summary.cell_profile(cells(spark, d)))


@query(f"""{CELLS_SQL}, z AS (SELECT *, row_number() OVER (ORDER BY round(severe_pct, 6) DESC, n DESC, cell) AS r FROM g WHERE n >= 10),
 c AS (SELECT cell, city FROM (SELECT cell, city, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, city) AS r FROM h GROUP BY 1, 2) WHERE r = 1)
 SELECT {CELL_COLS}, 'Z' || r AS zone, city FROM z LEFT JOIN w USING (cell) LEFT JOIN c USING (cell) WHERE r <= 5""")
def critical_zones(spark, d):
    rows = cells(spark, d)
    zones = summary.critical_zones(rounded(summary.cell_profile(rows)))
    return joins.attach_zone_names(zones, rows, "cell", ["city"])


@query(f"{I} SELECT state, county FROM (SELECT state, county, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, county) AS r FROM i GROUP BY 1, 2) WHERE r = 1")
def modal_county_of_state(spark, d):
    return summary.mode_by(incidents(spark, d), "state", "county")


@query(f"{I} SELECT weather_condition AS value, count(*) AS n FROM i WHERE weather_condition IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def modal_weather(spark, d):
    return summary.mode_value(incidents(spark, d), "weather_condition")


@query(f"{I}, c AS (SELECT severity, variable, level, count(*) AS n FROM (SELECT severity, 'weather' AS variable, weather_condition AS level FROM i UNION ALL SELECT severity, 'sun', sunrise_sunset FROM i) WHERE level IS NOT NULL GROUP BY ALL) SELECT severity, variable, level, n FROM (SELECT *, rank() OVER (PARTITION BY severity, variable ORDER BY n DESC) AS r FROM c) WHERE r = 1")
def modes_with_ties(spark, d):
    return summary.modes_by_cluster(incidents(spark, d).select("severity", F.col("weather_condition").alias("weather"), F.col("sunrise_sunset").alias("sun")), "severity", ["weather", "sun"])


@query(f"{I}, s AS (SELECT severity, count(*) AS n FROM i GROUP BY 1) SELECT count(*) AS clusters, min(n) AS min_n, max(n) AS max_n, round(min(n) / sum(n), 6) AS min_prop, round(max(n) / sum(n), 6) AS max_prop, round(max(n) / min(n), 6) AS imbalance, round(min(n) / max(n), 6) AS min_max FROM s")
def balance_of_clusters(spark, d):
    return rounded(summary.cluster_balance(incidents(spark, d), "severity"))


@query(f"{I} SELECT severity, variable, any_value(n) AS n, round(any_value(n) * 100.0 / any_value(total), 6) AS pct, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median FROM (SELECT severity, variable, value FROM (SELECT severity, {', '.join(NUM)} FROM i) UNPIVOT INCLUDE NULLS (value FOR variable IN ({', '.join(NUM)}))) JOIN (SELECT severity, count(*) AS n, sum(count(*)) OVER () AS total FROM i GROUP BY 1) USING (severity) GROUP BY 1, 2")
def numeric_profile_of_clusters(spark, d):
    return rounded(summary.cluster_numeric_profile(incidents(spark, d), "severity", NUM))


@query(f"{I} SELECT county, round(avg((severity >= 3)::INT), 6) AS severe_rate, round(avg(junction::INT), 6) AS junction_rate, round(avg(stop::INT), 6) AS stop_rate FROM i GROUP BY 1")
def rates_of_clusters(spark, d):
    df = incidents(spark, d).withColumns({f: F.col(f).cast("int") for f in ("junction", "stop")}).withColumn("s", F.col("severity"))
    return rounded(summary.cluster_rates(df, "county", ["junction", "stop"]))


@query(f"{I}, c AS (SELECT severity, 'weather' AS variable, weather_condition AS level, count(*) AS n FROM i WHERE weather_condition IS NOT NULL GROUP BY ALL) SELECT severity, variable, level, n, round(share, 6) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY severity) AS share FROM c) WHERE share > 0.05")
def categorical_profile_of_clusters(spark, d):
    return rounded(summary.cluster_categorical_profile(incidents(spark, d).withColumnRenamed("weather_condition", "weather"), "severity", ["weather"], 0.05))


CONT = """c AS (SELECT p_type AS row_cat, p_brand AS col_cat, count(*) AS n FROM part GROUP BY 1, 2), f AS (SELECT row_cat, col_cat, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_type AS row_cat FROM part) CROSS JOIN (SELECT DISTINCT p_brand AS col_cat FROM part) LEFT JOIN c USING (row_cat, col_cat))"""


@query(f"WITH {CONT} SELECT row_cat, col_cat, n, round(n / sum(n) OVER (PARTITION BY row_cat), 6) AS row_share, round(n / sum(n) OVER (PARTITION BY col_cat), 6) AS col_share FROM f")
def contingency_table(spark, d):
    return rounded(summary.contingency(t(spark, d, "part"), "p_type", "p_brand"))


@query("WITH c AS (SELECT user_id % 4 AS a, user_id % 3 AS b, count(*) AS n FROM events GROUP BY 1, 2) SELECT a::VARCHAR AS row_cat, b::VARCHAR AS col_cat, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS row_share, round(n / sum(n) OVER (PARTITION BY b), 6) AS col_share FROM c")
def crosstab_of_clusterings(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 4).alias("a"), (F.col("user_id") % 3).alias("b"))
    return rounded(summary.cluster_crosstab(e, "a", "b"))


@query(f"{I}, l AS (SELECT variable, severity, value FROM (SELECT severity, {', '.join(NUM)} FROM i) UNPIVOT (value FOR variable IN ({', '.join(NUM)}))) SELECT variable, 'max' AS series, round(max(value), 6) AS value FROM l GROUP BY 1 UNION ALL SELECT variable, 'min', round(min(value), 6) FROM l GROUP BY 1 UNION ALL SELECT variable, 'cluster ' || severity, round(avg(value), 6) FROM l GROUP BY variable, severity")
def radar_of_clusters(spark, d):
    return rounded(summary.radar_frame(incidents(spark, d), "severity", NUM))


@query(f"{I}, l AS (SELECT 'state' AS variable, state AS level FROM i UNION ALL SELECT 'severity', severity::VARCHAR FROM i UNION ALL SELECT 'wind_direction', wind_direction FROM i) SELECT variable, CASE variable WHEN 'severity' THEN 'int' ELSE 'string' END AS type, count(*) FILTER (level IS NULL) AS nulls, count(DISTINCT level) AS levels, array_to_string(list_sort(list_distinct(list(level) FILTER (level IS NOT NULL)))[1:5], '|') AS samples FROM l GROUP BY 1")
def variable_audit(spark, d):
    return summary.audit(incidents(spark, d), ["state", "severity", "wind_direction"])


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(44, floor((l_extendedprice - lo) / ((hi - lo) / 45)))::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def price_histogram(spark, d):
    return summary.histogram(t(spark, d, "lineitem"), "l_extendedprice")


@query(f"{CELLS_SQL} SELECT round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.9), 6) AS p90 FROM g")
def scale_limits(spark, d):
    return rounded(summary.quantile_of(cells(spark, d).groupBy("cell").agg(F.count("*").alias("n")), "n", [0.95, 0.9]))


MD5 = "md5(concat(event_id::VARCHAR, '42'))"


@query(f"WITH e AS (SELECT event_id, user_id % 7 AS g, md5(concat(event_id::VARCHAR, '42')) AS o FROM events) SELECT event_id, g FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, event_id) AS r FROM e) WHERE r <= 40")
def equal_samples(spark, d):
    return sampling.sample_per_group(t(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("g")), "g", 40, "event_id")


@query(f"SELECT event_id FROM events ORDER BY {MD5}, event_id LIMIT 500")
def sample_of_rows(spark, d):
    return sampling.sample_n(t(spark, d, "events").select("event_id"), 500, "event_id")


@query(f"WITH e AS (SELECT event_id, least(user_id % 50, 6) AS g, {MD5} AS o FROM events), s AS (SELECT g, count(*) AS n FROM e GROUP BY 1) SELECT event_id, g FROM (SELECT e.*, n, row_number() OVER (PARTITION BY g ORDER BY o, event_id) AS r FROM e JOIN s USING (g)) WHERE r <= least(n, greatest(100, ceil(0.35 * n)))")
def fraction_samples(spark, d):
    return sampling.sample_frac_per_group(t(spark, d, "events").select("event_id", F.least(F.col("user_id") % 50, F.lit(6)).alias("g")), "g", 0.35, 100, "event_id")


@query(f"WITH e AS (SELECT event_id, least(user_id % 50, 6) AS g, {MD5} AS o FROM events), s AS (SELECT g, count(*) AS n, sum(count(*)) OVER () AS total FROM e GROUP BY 1) SELECT event_id, g FROM (SELECT e.*, n, total, row_number() OVER (PARTITION BY g ORDER BY o, event_id) AS r FROM e JOIN s USING (g)) WHERE r <= least(n, greatest(10, round(n / total * 1000)))")
def proportional_samples(spark, d):
    return sampling.sample_proportional(t(spark, d, "events").select("event_id", F.least(F.col("user_id") % 50, F.lit(6)).alias("g")), "g", 1000, "event_id")


@query(f"{I} SELECT severity, level, n, r::INT AS rank FROM (SELECT severity, weather_condition AS level, count(*) AS n, row_number() OVER (PARTITION BY severity ORDER BY count(*) DESC, weather_condition) AS r FROM i WHERE weather_condition IS NOT NULL GROUP BY 1, 2) WHERE r <= 3")
def top_levels(spark, d):
    return sampling.top_levels_by_cluster(incidents(spark, d), "severity", "weather_condition", 3)


@query("""WITH l AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS price FROM part GROUP BY 1) SELECT p_brand, n, round(price, 6) AS price, rank_n::INT AS rank_n, rank_price::INT AS rank_price, (rank_n + rank_price)::INT AS rank_total FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rank_n, rank() OVER (ORDER BY price) AS rank_price FROM l)""")
def summed_ranks(spark, d):
    brands = t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price"))
    return rounded(summary.rank_total(brands, ["n"], ["price"]))


@query("WITH r AS (SELECT l_quantity AS q, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rk FROM lineitem) SELECT q AS l_quantity, rk AS rank, count(*) AS n FROM r GROUP BY 1, 2")
def average_ranks(spark, d):
    return summary.avg_rank(t(spark, d, "lineitem").select("l_quantity"), "l_quantity").groupBy("l_quantity", "rank").agg(F.count("*").alias("n"))


@query(f"""{I}, v AS (SELECT row_id, CASE WHEN pressure_in > 30.2 THEN 1 ELSE 0 END + CASE WHEN humidity > 90 THEN 1 ELSE 0 END AS votes FROM i WHERE pressure_in > 30.2 OR humidity > 90) SELECT row_id, coalesce(votes, 0)::BIGINT AS votes, CASE WHEN coalesce(votes, 0) >= 2 THEN 'out' ELSE 'in' END AS verdict FROM i LEFT JOIN v USING (row_id)""")
def attached_votes(spark, d):
    df = incidents(spark, d)
    flags = df.where("pressure_in > 30.2").select("row_id").union(df.where("humidity > 90").select("row_id"))
    votes = flags.groupBy("row_id").agg(F.count("*").alias("votes"))
    return joins.attach_votes(df.select("row_id"), votes, "row_id").withColumn("verdict", F.when(F.col("votes") >= 2, "out").otherwise("in"))


@query(f"{I} SELECT row_id FROM i WHERE NOT (distance_mi > 5 AND humidity IS NOT NULL AND humidity > 80)")
def rows_removed_by_id(spark, d):
    df = incidents(spark, d)
    return joins.remove_rows(df, df.where("distance_mi > 5 AND humidity > 80"), ["row_id"]).select("row_id")


@query(f"{I}, b AS (SELECT county, severity FROM i WHERE humidity > 98) SELECT row_id FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.county = i.county AND b.severity = i.severity)")
def rows_removed_by_value(spark, d):
    df = incidents(spark, d)
    return joins.remove_rows(df, df.where("humidity > 98"), ["county", "severity"]).select("row_id")


@query(f"{I} SELECT a.row_id, a.county FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.row_id = a.row_id AND b.row_id % 3 = 0)")
def rows_not_sampled(spark, d):
    df = incidents(spark, d).select("row_id", "county")
    return summary.rows_not_in(df, df.where("row_id % 3 = 0"), "row_id")


@query("WITH c AS (SELECT label, avg(embedding[1]) AS x, avg(embedding[2]) AS y FROM embeddings GROUP BY 1) SELECT a.label AS a, b.label AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance, row_number() OVER (PARTITION BY a.label ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.label)::INT AS rank FROM c a JOIN c b ON a.label <> b.label")
def distances_of_centroids(spark, d):
    c = t(spark, d, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0]).alias("x"), F.avg(F.col("embedding")[1]).alias("y"))
    out = joins.centroid_distances(c.withColumnRenamed("label", "a"), c.withColumnRenamed("label", "b"), "a", "b", ["x", "y"])
    return rounded(out.select("a", "b", "distance", "rank"))


@query("WITH e AS (SELECT event_type AS v, 'C' || (user_id % 3) AS b FROM events GROUP BY ALL) SELECT x.v AS event_type, y.b, x.v < y.b AS ordered FROM (SELECT DISTINCT v FROM e) x CROSS JOIN (SELECT DISTINCT b FROM e) y")
def complete_grid(spark, d):
    e = t(spark, d, "events").select("event_type", F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("b"))
    return joins.complete_grid(e.select("event_type").distinct(), e.select("b").distinct()).withColumn("ordered", F.col("event_type") < F.col("b"))


@query("WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT a.k AS i, b.k AS j, abs(a.n - b.n) AS gap FROM n a JOIN n b ON a.k < b.k")
def pairs_of_series(spark, d):
    n = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.pairs(n, "k").select(F.col("k_i").alias("i"), F.col("k_j").alias("j"), F.abs(F.col("n_i") - F.col("n_j")).alias("gap"))
