"""Tests of variables against clusters. After clustering they only describe, so results say p_value_descriptive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.order import avg_rank, cumulative
from tarmac.functions.stats import chi2_p, f_p, normal_p, t_p

P = "p_value_descriptive"


def _long(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).select(by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([by], cols, "variable", "value").where("value is not null")


def anova(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(variable, f, df1, df2, p): one-way analysis of variance, from n, mean and variance per group."""
    g = _long(df, cols, by).groupBy("variable", by).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    s = g.groupBy("variable").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") ** 2).alias("nm2"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("nm2") - F.col("nm") ** 2 / F.col("n")
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return s.where("k > 1").select("variable", f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2")).withColumn(P, f_p(F.col("f"), F.col("df1"), F.col("df2")))


def kruskal(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(variable, h, dof, p): rank test with tie correction, from counts of different values."""
    counts = _long(df, cols, by).groupBy("variable", by, "value").agg(F.count("*").alias("n"))
    ties = counts.groupBy("variable", "value").agg(F.sum("n").alias("t"))
    rank = cumulative(ties, ["value"], "t", "c", ["variable"]).withColumn("rank", F.col("c") - F.col("t") + (F.col("t") + 1) / 2)
    sums = counts.join(rank, ["variable", "value"]).groupBy("variable", by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    corr = rank.groupBy("variable").agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    h = sums.groupBy("variable").agg(F.sum("n").cast("double").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") ** 2 / F.col("n")).alias("s")).join(corr, "variable")
    raw = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    out = h.where("k > 1").select("variable", F.try_divide(raw, 1 - F.col("ties") / (F.col("n") ** 3 - F.col("n"))).alias("h"), (F.col("k") - 1).alias("dof"))
    return out.withColumn(P, chi2_p(F.col("h"), F.col("dof")))


def normality(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(variable, cluster, jb, p): Jarque-Bera by group, all moments in one pass over whole groups."""
    g = _long(df, cols, by).groupBy("variable", by).agg(F.count("*").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k"))
    jb = F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    return g.select("variable", by, jb.alias("jb")).withColumn(P, chi2_p(F.col("jb"), F.lit(2)))


def chi_square_by(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(variable, statistic, dof, p) of many categorical columns against clusters, counted in one pass."""
    d = df.where(F.col(by).isNotNull()).select(F.col(by).alias("g"), *[F.col(c).cast("string").alias(c) for c in cols])
    n = d.unpivot(["g"], cols, "variable", "level").where("level is not null").groupBy("variable", "level", "g").agg(F.count("*").alias("n"))
    w = lambda *p: F.sum("n").over(Window.partitionBy("variable", *p)).cast("double")
    m = n.withColumns({"n": F.col("n").cast("double"), "r": w("level"), "c": w("g"), "total": w()})
    s = m.groupBy("variable").agg((F.sum(F.col("n") * F.col("n") * F.col("total") / (F.col("r") * F.col("c"))) - F.max("total")).alias("statistic"), ((F.count_distinct("level") - 1) * (F.count_distinct("g") - 1)).alias("dof"))
    return s.withColumn(P, chi2_p(F.col("statistic"), F.col("dof")))


def test_variables(df: DataFrame, num: list[str], by: str, alpha: float = 0.05) -> DataFrame:
    """(variable, test, statistic, p): ANOVA where every group looks normal, else Kruskal-Wallis."""
    normal = normality(df, num, by).groupBy("variable").agg(F.min(F.col(P) > alpha).alias("normal"))
    a = anova(df, num, by).join(normal, "variable").where("normal").select("variable", F.lit("anova").alias("test"), F.col("f").alias("statistic"), P)
    k = kruskal(df, num, by).join(normal, "variable").where("not normal").select("variable", F.lit("kruskal").alias("test"), F.col("h").alias("statistic"), P)
    return a.union(k)


def significance(df: DataFrame, num: list[str], cat: list[str], by: str, alpha: float = 0.05) -> DataFrame:
    """(variable, type, test, statistic, p, significant) of all variables."""
    a = test_variables(df, num, by, alpha).withColumn("type", F.lit("numeric"))
    c = chi_square_by(df, cat, by).select("variable", F.lit("chi_square").alias("test"), "statistic", P, F.lit("categorical").alias("type"))
    return a.unionByName(c).withColumn("significant", F.col(P) < alpha)


def pairwise_means(df: DataFrame, col: str, by: str) -> DataFrame:
    """(a, b, diff, t, dof, p): pairs of groups with the pooled deviation of all groups, Bonferroni."""
    g = df.where(F.col(col).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("g")).agg(F.count("*").alias("n"), F.avg(col).alias("m"), F.coalesce(F.var_samp(col), F.lit(0.0)).alias("v"))
    pool = g.agg(F.sum((F.col("n") - 1) * F.col("v")).alias("ss"), F.sum(F.col("n") - 1).alias("dof"), (F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    a, b = (g.select(*[F.col(c).alias(f"{c}_{s}") for c in ("g", "n", "m")]) for s in "ab")
    d = a.join(b, F.col("g_a") < F.col("g_b")).crossJoin(F.broadcast(pool))
    se = F.sqrt(F.col("ss") / F.col("dof") * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = d.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), (F.col("m_b") - F.col("m_a")).alias("diff"), F.try_divide(F.col("m_b") - F.col("m_a"), se).alias("t"), "dof", "pairs")
    return out.withColumn(P, F.least(F.lit(1.0), t_p(F.col("t"), F.col("dof")) * F.col("pairs"))).drop("pairs")


def pairwise_wilcoxon(df: DataFrame, col: str, by: str) -> DataFrame:
    """(a, b, u, z, p): rank-sum tests of pairs of groups by the normal approximation with ties, Bonferroni.

    Works on counts of different values per pair, so groups of any size are aggregated first.
    """
    counts = df.where(F.col(col).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("g"), F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    groups = counts.select("g").distinct()
    pairs = groups.select(F.col("g").alias("a")).join(groups.select(F.col("g").alias("b")), F.col("a") < F.col("b"))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("g"))
    rows = counts.join(sides, "g").groupBy("a", "b", "v").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("n")).otherwise(0)).alias("na"), F.sum("n").alias("t"))
    ranked = cumulative(rows, ["v"], "t", "c", ["a", "b"]).withColumn("rank", F.col("c") - F.col("t") + (F.col("t") + 1) / 2)
    s = ranked.groupBy("a", "b").agg(F.sum(F.col("na") * F.col("rank")).alias("ra"), F.sum("na").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u = F.col("ra") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    out = s.select("a", "b", u.alias("u"), F.try_divide(u - n1 * n2 / 2, sd).alias("z"))
    k = groups.agg((F.count("*") * (F.count("*") - 1) / 2).alias("k"))
    return out.crossJoin(F.broadcast(k)).withColumn(P, F.least(F.lit(1.0), normal_p(F.col("z")) * F.col("k"))).drop("k")


def spearman_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = avg_rank(df, c, out=f"rank_{c}")
    return df
