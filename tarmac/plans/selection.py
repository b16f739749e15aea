"""Queries of stored tables, chosen rows and columns, and choices between models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import clean, features
from tarmac.operators import cluster, factor, impute, joins, outliers, profile, summary
from tarmac.plans.analysis import FCAT, FNUM, L, LIST, NEAR, base_rows
from tarmac.plans.common import I, query, rounded, t
from tarmac.plans.reports import NUM
from tarmac.sources import tables
from tarmac.sources.incidents import incidents
from tarmac.sources.stages import stage_path


@query(f"{I} SELECT 'first' AS part, row_id, county, NULL::DOUBLE AS humidity FROM i WHERE severity = 1 UNION ALL SELECT 'second', row_id, county, round(humidity, 6) FROM i WHERE severity = 2")
def stacked_parts(spark, d):
    df = incidents(spark, d).select("row_id", "county", "severity", "humidity")
    one, two = (df.where(F.col("severity") == s).withColumn("part", F.lit(p)) for s, p in ((1, "first"), (2, "second")))
    return rounded(clean.drop_columns(summary.stack(clean.drop_columns(one, ["humidity", "missing"]), two), ["severity"]))


@query(f"{I} (SELECT 'high' AS side, row_id, round(pressure_in, 6) AS pressure_in FROM i WHERE pressure_in IS NOT NULL ORDER BY i.pressure_in DESC, row_id LIMIT 15) UNION ALL (SELECT 'low', row_id, round(pressure_in, 6) FROM i WHERE pressure_in IS NOT NULL ORDER BY i.pressure_in, row_id LIMIT 15)")
def extreme_rows(spark, d):
    df = incidents(spark, d).select("row_id", "pressure_in").where("pressure_in is not null")
    high, low = (outliers.extremes(df, "pressure_in", 15, lowest=low).withColumn("side", F.lit(s)) for s, low in (("high", False), ("low", True)))
    return rounded(high.union(low))


@query(f"{I}, c AS (SELECT row_id, county, (severity % 2)::INT AS cluster FROM i WHERE row_id % 3 > 0) SELECT row_id, county, cluster FROM c")
def attached_clusters(spark, d):
    df = incidents(spark, d)
    labels = df.where("row_id % 3 > 0").select("row_id", (F.col("severity") % 2).alias("cluster"))
    return joins.attach_clusters(df.select("row_id", "county"), labels)


@query(f"{I}, {L}, m AS (SELECT variable, avg(value) AS mean FROM l GROUP BY 1) SELECT variable, round(mean, 6) AS mean FROM m WHERE variable IN (SELECT variable FROM l GROUP BY 1 HAVING max(value) > 60)")
def kept_variables(spark, d):
    long = incidents(spark, d).select(*NUM).unpivot([], NUM, "variable", "value")
    means = long.where("value is not null").groupBy("variable").agg(F.avg("value").alias("mean"))
    return rounded(joins.keep_variables(means, long.groupBy("variable").agg(F.max("value").alias("m")).where("m > 60"), ["variable"]))


@query("SELECT event_id AS id, event_type FROM events")
def rows_with_ids(spark, d):
    return summary.with_row_id(t(spark, d, "events").select("event_id", "event_type"), "event_id", "id").select("id", "event_type")


@query("WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderdate::DATE AS day FROM orders) SELECT o_orderkey, k, CASE WHEN k < 3 THEN day END AS day FROM o")
def parsed_times(spark, d):
    """Dates written in three ways, and one that isn't a date, read by the first format that fits."""
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    text = F.when(F.col("k") == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("k") == 1, F.date_format("ts", "MM/dd/yyyy HH:mm")).when(F.col("k") == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("none")
    return o.select("o_orderkey", "k", F.to_date(features.parse_ts(text)).alias("day"))


@query(f"{I}, {L.replace('row_id', 'severity')}, g AS (SELECT severity AS k, variable, avg(value) AS mean, count(*) AS n FROM l GROUP BY 1, 2) SELECT k::INT AS k, variable, round(mean, 6) AS mean, n FROM g")
def stored_profiles(spark, d):
    """Profiles written as a folder per k and variable, and read back."""
    long = incidents(spark, d).select(F.col("severity").alias("k"), *NUM).unpivot(["k"], NUM, "variable", "value").where("value is not null")
    path = stage_path(spark, "profiles")
    tables.write_profiles(long.groupBy("k", "variable").agg(F.avg("value").alias("mean"), F.count("*").alias("n")), path)
    return rounded(tables.read_stage(spark, path).select(F.col("k").cast("int").alias("k"), "variable", "mean", "n"))


@query("WITH m AS (SELECT p_size AS k, avg(p_retailprice) AS silhouette, count(*) > 40 AS valid FROM part GROUP BY 1) SELECT k, round(silhouette, 6) AS silhouette, valid FROM m ORDER BY valid DESC, m.silhouette DESC, k LIMIT 1")
def best_of_models(spark, d):
    m = t(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.avg("p_retailprice").alias("silhouette"), (F.count("*") > 40).alias("valid"))
    return rounded(summary.best_model(m))


@query()
def local_outlier_factors(spark, d):
    return rounded(outliers.lof_scores(incidents(spark, d), NUM), 4)


@query(f"{NEAR} SELECT row_id, round(d, 6) AS distance, rn::INT AS rank FROM k WHERE rn <= 3")
def nearest_rows(spark, d):
    from tarmac.operators.neighbours import knn_join, standardised

    z = standardised(incidents(spark, d), NUM, "row_id")
    return rounded(knn_join(z, z, NUM, 3).drop("neighbour"))  # which of equally near ones comes first hangs on the last digit


@query()
def imputed_several_times(spark, d):
    return impute.impute_multiple(incidents(spark, d).select("row_id", "humidity", "pressure_in"), ["humidity", "pressure_in"], 3, sweeps=1)


@query()
def mca_individuals(spark, d):
    """Coordinates, squared cosines and contributions of every row, from axes that were stored and read back."""
    base, dims = base_rows(spark, d), ["dim_1", "dim_2"]
    axes = factor.mca(base, FCAT, 2)
    path = stage_path(spark, "axes")
    tables.save_axes(factor.eigen_table(spark, axes.values), path)
    values = [r.eigenvalue for r in tables.read_stage(spark, path).orderBy("axis").limit(2).collect()]
    return rounded(factor.individuals(axes.project(base, 2, ["row_id"]), dims, values))


@query()
def mca_supplementary_numbers(spark, d):
    base, dims = base_rows(spark, d), ["dim_1", "dim_2"]
    return rounded(factor.supplementary_numeric(factor.mca(base, FCAT, 2).project(base, 2, FNUM), FNUM, dims))


@query()
def kprototypes_choice(spark, d):
    """The number of clusters by silhouettes of mixed distance, of models whose clusters are large enough."""
    metrics, _ = cluster.kprototypes_grid(base_rows(spark, d), FNUM, FCAT, [2, 3, 4], n_init=20, max_iter=8)
    return rounded(cluster.select_clustering(metrics), 4)


BLOCK = "CASE " + " ".join(f"WHEN regexp_matches(lower(variable), '{p}') THEN '{g}'" for p, g in features.BLOCKS) + " ELSE '5. Otras' END"
LEVEL = "CASE WHEN v <= -4 THEN 'Muy bajo' WHEN v < -1.96 THEN 'Bajo' WHEN v <= 1.96 THEN 'Neutro' WHEN v < 4 THEN 'Alto' ELSE 'Muy alto' END"
VTESTS = "g AS (SELECT cluster, variable, count(*) AS n, avg(value) AS m FROM l GROUP BY 1, 2), o AS (SELECT variable, count(*) AS n0, avg(value) AS m0, var_pop(value) AS s2 FROM l GROUP BY 1), w AS (SELECT cluster, variable, (m - m0) / sqrt(s2 / n * (n0 - n) / (n0 - 1)) AS raw FROM g JOIN o USING (variable))"


@query(f"""{I}, l AS (SELECT cluster, variable, value FROM (SELECT (severity >= 3)::INT AS cluster, {', '.join(f'{c}::DOUBLE AS {c}' for c in NUM)}, severity::DOUBLE AS severity FROM i) UNPIVOT (value FOR variable IN ({LIST}, severity))), {VTESTS},
 x AS (SELECT cluster, variable, {BLOCK} AS block, greatest(least(raw, 10), -10) AS v FROM w WHERE abs(raw) >= 0.5), m AS (SELECT block, variable, max(abs(v)) AS m FROM x GROUP BY 1, 2),
 c AS (SELECT block, variable FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY m DESC, variable) AS r FROM m WHERE m >= 2 OR contains(variable, 'severity')) WHERE r <= 12)
 SELECT cluster, variable, block, round(v, 4) AS v_test, {LEVEL} AS level FROM x JOIN c USING (block, variable)""")
def traffic_light_panel(spark, d):
    df = incidents(spark, d).withColumn("severe", (F.col("severity") >= 3).cast("int"))
    vt = profile.vtest_numeric(df, [*NUM, "severity"], "severe").select("cluster", "variable", "v_test")
    return rounded(profile.traffic_light(vt, strong=2.0, keep=0.5), 4)


@query(f"""{I}, l AS (SELECT severity AS cluster, variable, value FROM (SELECT severity, {LIST} FROM i) UNPIVOT (value FOR variable IN ({LIST}))), {VTESTS}, s AS (SELECT severity AS cluster, count(*) AS n FROM i GROUP BY 1)
 SELECT cluster, n, variable, block, round(v, 4) + 0.0 AS v_test, {LEVEL} AS level FROM (SELECT s.cluster, s.n, y.variable, {BLOCK.replace('variable', 'y.variable')} AS block, coalesce(raw, 0) AS v FROM s CROSS JOIN (SELECT DISTINCT variable FROM w) y LEFT JOIN w ON w.cluster = s.cluster AND w.variable = y.variable)""")
def traffic_light_grid(spark, d):
    df = incidents(spark, d)
    sizes = df.groupBy(F.col("severity").alias("cluster")).agg(F.count("*").alias("n"))
    return rounded(profile.tlp_grid(profile.vtest_numeric(df, NUM, "severity"), sizes), 4)
