"""Correlation and association of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.stats import chi2_p
from tarmac.functions.order import avg_rank, cumulative, ranged
from tarmac.operators.summary import contingency, frequencies


#: Most rows or columns of a table that is simulated.
MOST_LEVELS = 2000


def correlation(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for all pairs of columns, rows complete in both, in one aggregate. spearman ranks each column first."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if method == "spearman":
        for c in cols:
            d = avg_rank(d, c, out=f"__r_{c}").drop(c).withColumnRenamed(f"__r_{c}", c)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = d.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "r").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")
    return long.union(long.where("a <> b").select("b", "a", "r"))


def redundant(corr: DataFrame, cut: float = 0.85) -> list[str]:
    """Columns to drop: of each pair over the cut, in order of strength, the one of the larger mean correlation (to 9 digits; then by name)."""
    rows = {(r.a, r.b): abs(r.r or 0.0) for r in corr.collect()}
    cols = sorted({a for a, _ in rows})
    mean = {c: round(sum(rows[c, o] for o in cols if o != c) / max(len(cols) - 1, 1), 9) for c in cols}
    gone: list[str] = []
    for (a, b), r in sorted(rows.items(), key=lambda x: (-round(x[1], 9), x[0])):
        if a < b and r > cut and a not in gone and b not in gone:
            gone.append(max((a, b), key=lambda c: (mean[c], c)))
    return sorted(gone)


def xi(df: DataFrame, x: str, y: str, key: str = "row_id") -> DataFrame:
    """(x, y, n, xi): Chatterjee's coefficient; ties in x are ordered by key.

    1 - n * sum |r(i+1) - r(i)| / (2 * sum l(i) * (n - l(i))), r and l the numbers of values not above, not below. Sums and
    products are doubles, since they grow with the cube of the rows.
    Rows are sorted in range partitions; the row after a partition's last one is the first of the next partition.
    """
    d = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    counts = d.groupBy("y").agg(F.count("*").alias("m"))
    total = d.agg(F.count("*").alias("n"))
    ranks = cumulative(counts, ["y"], "m", "r").crossJoin(F.broadcast(total)).select(F.col("y").alias("__y"), "r", (F.col("n") - F.col("r") + F.col("m")).alias("l"), "n")
    rows = ranged(d.join(ranks, F.col("y") == F.col("__y")).select("x", key, "r", "l", "n"), ["x", key])
    first = rows.groupBy("__range").agg(F.min_by("r", F.struct("x", key)).alias("r"))
    next_ = first.select("__range", F.lead("r").over(Window.orderBy("__range")).alias("__next"))  # a row for each partition
    after = F.coalesce(F.lead("r").over(Window.partitionBy("__range").orderBy("x", key)), F.col("__next"))
    pairs = rows.join(F.broadcast(next_), "__range").withColumn("after", after)
    n, ll = (F.col(c).cast("double") for c in ("n", "l"))
    s = pairs.agg(F.sum(F.abs(F.col("after") - F.col("r")).cast("double")).alias("d"), F.sum(ll * (n - ll)).alias("b"), F.max("n").alias("n"))
    return s.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", (1 - F.try_divide(n * F.col("d"), 2 * F.col("b"))).alias("xi"))


def xi_matrix(df: DataFrame, cols: list[str], key: str = "row_id", low: float | None = None, high: float | None = None) -> DataFrame:
    """xi of all ordered pairs; with limits, those between them."""
    parts = [xi(df, a, b, key) for a in cols for b in cols if a != b]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out if low is None else out.where((F.col("xi") > low) & (F.col("xi") < high))


def near_zero_variance(df: DataFrame, cols: list[str], ratio: float = 95 / 5, unique: float = 10.0) -> DataFrame:
    """(variable, freq_ratio, unique_pct, nzv): most to second-most frequent value, and different values per 100 rows."""
    counts = frequencies(df, cols)
    w = Window.partitionBy("variable").orderBy(F.desc("n"), "level")
    top = counts.withColumn("r", F.row_number().over(w)).groupBy("variable").agg(F.max(F.when(F.col("r") == 1, F.col("n"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("b"), F.count("*").alias("levels"), F.sum("n").alias("total"))
    out = top.select("variable", F.coalesce(F.col("a") / F.col("b"), F.lit(0.0)).alias("freq_ratio"), (F.col("levels") * 100 / F.col("total")).alias("unique_pct"), "levels")
    return out.withColumn("nzv", ((F.col("freq_ratio") > ratio) & (F.col("unique_pct") <= unique)) | (F.col("levels") == 1)).drop("levels")


def residuals(df: DataFrame, r: str, c: str) -> DataFrame:
    """(row_cat, col_cat, n, expected, residual): adjusted standardised residuals."""
    cells = contingency(df, r, c).select("row_cat", "col_cat", "n")
    rows, cols, every = (F.sum("n").over(Window.partitionBy(*p)).cast("double") for p in (["row_cat"], ["col_cat"], []))
    d = cells.withColumns({"__r": rows, "__c": cols}).withColumn("__t", every)
    e = F.col("__r") * F.col("__c") / F.col("__t")
    adj = F.sqrt(e * (1 - F.col("__r") / F.col("__t")) * (1 - F.col("__c") / F.col("__t")))
    return d.select("row_cat", "col_cat", "n", e.alias("expected"), F.try_divide(F.col("n") - e, adj).alias("residual"))


def relevant_cells(res: DataFrame, cut: float = 2.0) -> DataFrame:
    return res.where(F.abs("residual") > cut).orderBy(F.desc(F.abs("residual")), "row_cat", "col_cat")


def chi_square(df: DataFrame, r: str, c: str, simulate: int = 0, seed: int = 1) -> DataFrame:
    """(statistic, dof, n, min_expected, p_value); p from `simulate` random tables where an expected count is under 5."""
    cells = residuals(df, r, c)
    stat = cells.agg(F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("statistic"), ((F.count_distinct("row_cat") - 1) * (F.count_distinct("col_cat") - 1)).alias("dof"), F.sum("n").alias("n"), F.min("expected").alias("min_expected"))
    out = stat.withColumn("p_value", chi2_p(F.col("statistic"), F.col("dof")))
    if not simulate:
        return out
    got = stat.first()
    if got.min_expected is None or got.min_expected >= 5:
        return out
    margins = [[x[0] for x in cells.groupBy(k).agg(F.sum("n").alias("n")).orderBy(k).select("n").limit(MOST_LEVELS + 1).collect()] for k in ("row_cat", "col_cat")]
    if max(map(len, margins)) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels to simulate")
    return stat.withColumn("p_value", F.lit(simulated_p(df.sparkSession, *margins, float(got.statistic), simulate, seed)))


def simulated_p(spark, rows: list[int], cols: list[int], statistic: float, tables: int, seed: int) -> float:
    """Share of random tables with these margins whose statistic reaches the observed one, itself included.

    A table is drawn row by row from multivariate hypergeometric distributions, so its cost doesn't grow with n.
    """
    import numpy as np
    import pandas as pd

    r, c = np.array(rows, np.int64), np.array(cols, np.int64)
    expected = np.outer(r, c) / r.sum()

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf.id:
                rng = np.random.default_rng([seed, int(i)])
                left, table = c.copy(), np.zeros((len(r), len(c)))
                for k, n in enumerate(r):
                    table[k] = rng.multivariate_hypergeometric(left, n, method="marginals") if k < len(r) - 1 else left
                    left = left - table[k].astype(np.int64)
                out.append(bool(((table - expected) ** 2 / expected).sum() >= statistic * (1 - 1e-9)))
            yield pd.DataFrame({"hit": out})

    hits = spark.range(tables).mapInPandas(run, "hit boolean").agg(F.count_if("hit")).first()[0]
    return (hits + 1) / (tables + 1)


def cramers_v(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(variable, v) of each column against the target, strongest first. All columns are counted in one pass."""
    d = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("t"), *[F.col(c).cast("string").alias(c) for c in cols])
    n = d.unpivot(["t"], cols, "variable", "level").where("level is not null").groupBy("variable", "level", "t").agg(F.count("*").alias("n"))
    w = lambda *p: F.sum("n").over(Window.partitionBy("variable", *p)).cast("double")
    m = n.withColumns({"n": F.col("n").cast("double"), "r": w("level"), "c": w("t"), "total": w()})
    # empty cells add their expected counts, which sum to total minus those of the filled cells
    s = m.groupBy("variable").agg((F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c") / F.col("total"))) - F.max("total")).alias("chi2"), F.max("total").alias("total"), F.count_distinct("level").alias("a"), F.count_distinct("t").alias("b"))
    return s.select("variable", F.sqrt(F.try_divide(F.greatest(F.col("chi2"), F.lit(0.0)), F.col("total") * (F.least("a", "b") - 1))).alias("v")).orderBy(F.desc("v"), "variable")


def rf_importance(df: DataFrame, features: list[str], label: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """(variable, importance) of a random forest for the label, strongest first; text columns are indexed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from tarmac.operators.summary import is_numeric

    text = [c for c in features if not is_numeric(df.schema[c].dataType)]
    d = df.dropna(subset=[*features, label]).withColumns({c: F.col(c).cast("string") for c in text})
    steps = [StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip"), *[StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep") for c in text], VectorAssembler(inputCols=[f"__i_{c}" if c in text else c for c in features], outputCol="__x"), RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=5, maxBins=128, seed=seed)]
    fitted = Pipeline(stages=steps).fit(d).stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(features, fitted, strict=True)], "variable string, importance double").orderBy(F.desc("importance"), "variable")
