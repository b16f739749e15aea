"""v-tests of clusters and the traffic-light panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.features import clip, semantic_group, vtest_level
from tarmac.functions.stats import hypergeometric_vtest
from tarmac.operators.joins import complete_grid, keep_variables


def vtest_numeric(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(cluster, variable, mean, overall_mean, v_test): sqrt of the finite-population variance of a mean."""
    long = df.where(F.col(by).isNotNull()).select(by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([by], cols, "variable", "value").where("value is not null")
    g = long.groupBy(by, "variable").agg(F.count("*").alias("nk"), F.avg("value").alias("mean"))
    t = long.groupBy("variable").agg(F.count("*").alias("n"), F.avg("value").alias("overall_mean"), F.var_pop("value").alias("s2"))
    se = F.sqrt(F.col("s2") / F.col("nk") * (F.col("n") - F.col("nk")) / (F.col("n") - 1))
    return g.join(F.broadcast(t), "variable").select(F.col(by).alias("cluster"), "variable", "mean", "overall_mean", F.try_divide(F.col("mean") - F.col("overall_mean"), se).alias("v_test"))


def vtest_category(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(cluster, variable, level, n, level_in_cluster, cluster_in_level, overall, v_test) by the hypergeometric law."""
    long = df.where(F.col(by).isNotNull()).select(by, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([by], cols, "variable", "level").where("level is not null")
    n = long.groupBy(by, "variable", "level").agg(F.count("*").alias("n"))
    full = n.select(by).distinct().crossJoin(n.select("variable", "level").distinct()).join(n, [by, "variable", "level"], "left").fillna(0, ["n"])
    w = lambda *p: F.sum("n").over(Window.partitionBy("variable", *p))
    d = full.withColumns({"nk": w(by), "nj": w("level"), "total": w()})
    return d.withColumn("v_test", hypergeometric_vtest(F.col("n"), F.col("nk"), F.col("nj"), F.col("total"))).select(F.col(by).alias("cluster"), "variable", "level", "n", F.try_divide(F.col("n"), F.col("nk")).alias("level_in_cluster"), F.try_divide(F.col("n"), F.col("nj")).alias("cluster_in_level"), (F.col("nj") / F.col("total")).alias("overall"), "v_test")


def variable_ranking(vt: DataFrame) -> DataFrame:
    """(variable, max_abs_vtest), strongest first."""
    return vt.groupBy("variable").agg(F.max(F.abs("v_test")).alias("max_abs_vtest")).orderBy(F.desc("max_abs_vtest"), "variable")


def tlp_grid(vt: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every cluster with every variable: (cluster, n, variable, block, v_test, level); no test is 0."""
    grid = complete_grid(sizes.select("cluster", "n"), vt.select("variable").distinct())
    out = grid.join(vt.select("cluster", "variable", "v_test"), ["cluster", "variable"], "left").fillna(0.0, ["v_test"])
    return out.select("cluster", "n", "variable", semantic_group(F.col("variable")).alias("block"), "v_test", vtest_level(F.col("v_test")).alias("level"))


def traffic_light(vt: DataFrame, strong: float = 4.0, cap: float = 10.0, keep: float = 1.96, per_block: int = 12) -> DataFrame:
    """The panel: tests of at least `keep` capped at ±cap, of the per_block strongest variables of each block
    that reach `strong` somewhere (severity always stays)."""
    t = vt.where(F.abs("v_test") >= keep).withColumns({"block": semantic_group(F.col("variable")), "v_test": clip(F.col("v_test"), -cap, cap)}).withColumn("level", vtest_level(F.col("v_test")))
    top = t.groupBy("block", "variable").agg(F.max(F.abs("v_test")).alias("m")).where((F.col("m") >= strong) | F.lower("variable").contains("severity"))
    chosen = top.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("m"), "variable"))).where(F.col("r") <= per_block)
    return keep_variables(t, chosen, ["variable", "block"])
