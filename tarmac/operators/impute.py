"""Filling of missing values. Observed values never change."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.order import cumulative, quantiles
from tarmac.operators.mixed import nearest_mixed
from tarmac.operators.neighbours import ranges_of
from tarmac.operators.sampling import order_of
from tarmac.operators.summary import mode_value
from tarmac.sources.stages import remove, scratch, stage_path, staged

#: Most levels of a label column that takes part in a chain, most coefficients of a multinomial regression.
MOST_LEVELS, MOST_COEFFICIENTS = 200, 1000


def impute_simple(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """spec: column to mean, median, mode, or =text for a level of that name."""
    means, medians = ([c for c, how in spec.items() if how == kind] for kind in ("mean", "median"))
    fills: dict = df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict() if means else {}
    if medians:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in medians]).unpivot([], medians, "variable", "value")
        fills |= {r.variable: r.m for r in quantiles(long, ["variable"], "value", {"m": 0.5}).collect()}
    for c, how in spec.items():
        if how == "mode":
            got = mode_value(df, c).first()
            fills[c] = got.value if got else None
        elif how.startswith("="):
            fills[c] = how[1:]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None})


def impute_random(df: DataFrame, col: str, key: str = "row_id", seed: int = 500) -> DataFrame:
    """A missing value becomes that of an observed row, drawn by hash: observed rows are numbered within
    hash buckets, and a missing row takes one of its bucket. No order over all rows is needed."""
    n = df.agg(F.count(col)).first()[0]
    if not n:
        return df
    buckets = max(1, n // 64)
    bucket = lambda s: F.pmod(F.xxhash64(key, F.lit(seed + s)), F.lit(buckets))
    seen = df.where(F.col(col).isNotNull()).select(bucket(0).alias("__b"), F.col(col).alias("__v"), F.col(key).alias("__k"))
    seen = seen.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy("__k")) - 1)
    sizes = seen.groupBy("__b").agg(F.count("*").alias("__n"))
    # a bucket may be without observed rows; its missing ones all take the same observed value
    miss = df.where(F.col(col).isNull()).select(key, bucket(1).alias("__b"))
    used = sizes.select(F.col("__b"), "__n")
    draw = miss.join(used, "__b", "left")
    direct = draw.where("__n is not null").withColumn("__i", F.pmod(F.xxhash64(key, F.lit(seed + 2)), F.col("__n"))).join(seen.select("__b", "__i", "__v"), ["__b", "__i"]).select(key, "__v")
    first = seen.orderBy(F.xxhash64("__k", F.lit(seed)), "__k").limit(1).select(F.col("__v").alias("__first"))
    return df.join(direct, key, "left").crossJoin(F.broadcast(first)).withColumn(col, F.coalesce(F.col(col), F.col("__v"), F.col("__first"))).drop("__v", "__first")


def impute_group_mean(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """The mean of the group; groups without a value keep nulls. Means are aggregated before the join."""
    means = df.groupBy(*by).agg(F.avg(col).alias("__m"))
    named = means.select(*[F.col(b).alias(f"__{b}") for b in by], "__m")
    on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    return df.join(named, on, "left").withColumn(col, F.coalesce(F.col(col), F.col("__m"))).drop("__m", *[f"__{b}" for b in by])


def _gram(rows: DataFrame, cols: list[str], weight: str | None = None) -> np.ndarray:
    """Sums of products of (1, cols) over all rows, each `weight` times, from one partial matrix per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(cols) + 1, len(cols) + 1))
        for pdf in batches:
            m = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)])
            total += m.T @ (m * pdf[weight].to_numpy(float)[:, None] if weight else m)
        yield pd.DataFrame({"r": np.arange(len(total)), "g": list(total)})

    return _added(rows.select(*cols, *([weight] if weight else [])).mapInPandas(run, "r int, g array<double>"), len(cols) + 1)


def _added(parts: DataFrame, n: int) -> np.ndarray:
    """The sum of matrices of n rows that come as (r, g), a row of one of them each. Numbers are added in their own order: partitions come
    in any, since Spark reads written files by length, and files of one length as the folder lists them."""
    total = parts.groupBy("r").applyInPandas(lambda pdf: pd.DataFrame({"r": pdf.r.iloc[:1], "g": [np.sum(np.sort(np.stack(pdf.g.to_numpy()), 0), 0)]}), "r int, g array<double>").collect()
    return np.array([r.g for r in sorted(total, key=lambda r: r.r)]) if total else np.zeros((n, n))


def _solve(gram: np.ndarray) -> np.ndarray:
    a, b = gram[:-1, :-1], gram[:-1, -1]
    return np.linalg.solve(a + 1e-8 * np.diag(np.maximum(np.diag(a), 1e-12)), b)


def _linear(x: list[Column], beta: np.ndarray) -> Column:
    out = F.lit(float(beta[0]))
    for c, b in zip(x, beta[1:], strict=True):
        out = out + c * float(b)
    return out


def levels_of(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """The levels of each label column, the most frequent first (then by name); MOST_LEVELS at most."""
    out = {}
    for c in cols:
        got = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count().orderBy(F.desc("count"), "v").limit(MOST_LEVELS + 1).collect()
        if len(got) > MOST_LEVELS:
            raise ValueError(f"more than {MOST_LEVELS} levels in {c}")
        out[c] = [r.v for r in got]
    return out


def _predictors(others: list[str], levels: dict[str, list[str]]) -> list[Column]:
    """Numbers, and an indicator for each level but the first of the labels."""
    out = []
    for c in others:
        out += [(F.col(c) == v).cast("double") for v in levels[c][1:]] if c in levels else [F.col(c)]
    return out


def poisson_weight(key: str, *salt) -> Column:
    """How often a row occurs in a bootstrap sample: a Poisson number of mean 1, by hash."""
    u = (F.xxhash64(key, *map(F.lit, salt)) / float(2**63) + 1) / 2
    at, step = [], math.exp(-1)
    total = step
    for n in range(1, 12):
        at.append(total)
        step /= n
        total += step
    return sum(((u >= a).cast("double") for a in at), F.lit(0.0))


def canonical(gram: np.ndarray, p: int) -> np.ndarray:
    """Weights of p predictors whose sum correlates most with a scoring of the levels, from products of (1, predictors, indicators)."""
    n = max(gram[0, 0], 1e-12)
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    root = []
    for block in (cov[:p, :p], cov[p:, p:]):
        values, vectors = np.linalg.eigh(block)
        keep = values > 1e-9 * max(values.max(initial=0.0), 1e-12)
        root.append((vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T)
    u = np.linalg.svd(root[0] @ cov[:p, p:] @ root[1])[0][:, 0]
    b = root[0] @ u
    return b * (1 if b[np.abs(b).argmax()] > 0 else -1)


def multinomial(rows: DataFrame, x: list[str], y: str, k: int, weight: str | None = None, steps: int = 30, ridge: float = 1e-6) -> np.ndarray:
    """(k, 1 + len(x)) coefficients of a multinomial logistic regression of y, numbers from 0 to k - 1; level 0 has zeros.

    Newton steps: each scans the rows once and adds up gradients and blocks of the second derivatives, in (k - 1) * (1 +
    len(x)) rows, MOST_COEFFICIENTS at most; a step that lowers the likelihood is halved. `ridge` times the sum of weights,
    on predictors as z-scores, keeps the solution finite where levels can be told apart.
    """
    size = (k - 1) * (1 + len(x))
    if size > MOST_COEFFICIENTS:
        raise ValueError(f"more than {MOST_COEFFICIENTS} coefficients")
    gram = _gram(rows, x, weight)
    n, mean = max(gram[0, 0], 1e-12), gram[0, 1:] / max(gram[0, 0], 1e-12)
    sd = np.sqrt(np.maximum(np.diag(gram)[1:] / n - mean**2, 0))
    sd[sd < 1e-12] = np.inf

    def sums(beta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((size + 1, size + 1))
            for whole in batches:
                for a in range(0, len(whole), 4096):
                    pdf = whole.iloc[a : a + 4096]
                    m = np.column_stack([np.ones(len(pdf)), (pdf[x].to_numpy(float) - mean) / sd])
                    w = pdf[weight].to_numpy(float) if weight else np.ones(len(pdf))
                    z = m @ beta.T
                    z -= z.max(1, keepdims=True)
                    prob = np.exp(z)
                    prob /= prob.sum(1, keepdims=True)
                    own = pdf[y].to_numpy(int)[:, None] == np.arange(k)[None]
                    total[-1, -1] += (w * np.log(np.maximum(prob[own], 1e-300))).sum()
                    total[:-1, -1] += (m.T @ (w[:, None] * (own - prob)))[:, 1:].T.ravel()
                    for i in range(1, k):
                        for j in range(i, k):
                            block = m.T @ (m * (w * prob[:, i] * ((i == j) - prob[:, j]))[:, None])
                            p = len(block)
                            total[(i - 1) * p : i * p, (j - 1) * p : j * p] += block
                            if i != j:
                                total[(j - 1) * p : j * p, (i - 1) * p : i * p] += block.T
            yield pd.DataFrame({"r": np.arange(size + 1), "g": list(total)})

        return _added(rows.select(*x, y, *([weight] if weight else [])).mapInPandas(run, "r int, g array<double>"), size + 1)

    penalty = np.tile(np.r_[0.0, np.full(len(x), ridge * n)], k - 1)
    whole = lambda flat: np.vstack([np.zeros(1 + len(x)), flat.reshape(k - 1, -1)])
    value = lambda t, flat: t[-1, -1] - (penalty * flat**2).sum() / 2
    flat = np.zeros(size)
    at = sums(whole(flat)) if size else None
    for _ in range(steps if size else 0):
        step = np.linalg.solve(at[:-1, :-1] + np.diag(penalty + 1e-10 * n), at[:-1, -1] - penalty * flat)
        new, share = sums(whole(flat + step)), 1.0
        while value(new, flat + share * step) < value(at, flat) - 1e-9 * n and share > 1e-3:
            share /= 2
            new = sums(whole(flat + share * step))
        flat, at = flat + share * step, new
        if np.abs(share * step).max() < 1e-8:
            break
    beta = whole(flat)
    beta[:, 1:] /= sd
    beta[:, 0] -= beta[:, 1:] @ mean
    return beta


def _chain(df: DataFrame, cols: list[str], sweeps: int, key: str, fill, levels: dict[str, list[str]]) -> DataFrame:
    """Sweeps over columns with nulls; fill(df, others, col, sweep) gives new values in __new. Others hold current values.

    First values are means and the most frequent levels. Each column is written before the next one uses it, and what it was made from goes.
    """
    spark = df.sparkSession
    marked = df.withColumns({f"__miss_{c}": F.col(c).isNull() for c in cols})
    now, before = impute_simple(marked.withColumns({c: F.col(c).cast("double") for c in cols if c not in levels}), {c: "mode" if c in levels else "mean" for c in cols}), None
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    for s in range(sweeps):
        for c in [c for c in cols if gaps[c]]:
            path = stage_path(spark, "impute")
            with scratch(spark):
                new = fill(now, [o for o in cols if o != c], c, s)
                new.withColumn(c, F.when(F.col(f"__miss_{c}"), F.col("__new")).otherwise(F.col(c))).select(*now.columns).write.parquet(path)
            now = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return now.drop(*[f"__miss_{c}" for c in cols])


def _fitting_rows(now: DataFrame, x: list[Column], c: str, key: str, weight: Column | None, target: list[Column]) -> tuple[DataFrame, list[str], list[str]]:
    """Rows that have c, with predictors __x0.., targets __y0.. and __w."""
    xs, ys = [f"__x{i}" for i in range(len(x))], [f"__y{i}" for i in range(len(target))]
    cols = [v.cast("double").alias(n) for v, n in zip([*x, *target], [*xs, *ys], strict=True)]
    return now.where(~F.col(f"__miss_{c}")).select(*cols, (weight if weight is not None else F.lit(1.0)).alias("__w")), xs, ys


def _labels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Levels of those of cols that are text."""
    return levels_of(df, [c for c in cols if dict(df.dtypes)[c] == "string"])


def _donors(now: DataFrame, pred: Column, c: str, key: str, k: int) -> DataFrame:
    """(key, __near) of each row that misses c: (distance, prediction, key, value) of the k donors nearest to its prediction.

    All rows are numbered by prediction, observed ones counting; a missing row's place says which numbers can be near.
    """
    rows = now.select(key, pred.alias("__p"), F.col(f"__miss_{c}").alias("__m"), F.col(c).alias("__v")).withColumn("__one", (~F.col("__m")).cast("int"))
    placed = staged(cumulative(rows, ["__p", "__m", key], "__one", "__c"), "placed")  # read for both sides
    seen = placed.where("not __m").select(F.col("__c").alias("__at"), F.struct("__p", F.col(key).alias("__k"), "__v").alias("__donor"))
    miss = placed.where("__m").select(key, "__p", "__c")
    spots = miss.select("__c").distinct().withColumn("__at", F.explode(F.sequence(F.col("__c") - (k - 1), F.col("__c") + k)))
    lists = spots.join(seen, "__at").groupBy("__c").agg(F.collect_list("__donor").alias("__l"))  # 2 * k at most
    far = lambda x: F.struct(F.abs(x["__p"] - F.col("__p")).alias("d"), x["__p"].alias("p"), x["__k"].alias("k"), x["__v"].alias("v"))
    return miss.join(lists, "__c").select(key, F.slice(F.sort_array(F.transform("__l", far)), 1, k).alias("__near"))


def impute_pmm(df: DataFrame, cols: list[str], m: int = 1, sweeps: int = 5, key: str = "row_id", seed: int = 500, k: int = 5, average: bool = False, bootstrap: bool = False) -> DataFrame:
    """Chained predictive mean matching of numeric and text columns.

    A number's prediction is linear in the other columns, from sums of products over all rows; a label's is their canonical
    variate with its levels. A missing value becomes the observed value of one of the k donors of nearest prediction, drawn by
    hash, of all observed rows (of equally near ones, those next to it in the order of prediction and key). With average, m
    draws of a number are averaged in each sweep, and of a label the first counts; impute_multiple gives m tables. With bootstrap,
    predictions are fitted to rows weighted by hash as a sample with replacement is. A text column without a value stays as it is.
    """
    levels = _labels(df, cols)

    def fill(now: DataFrame, others: list[str], c: str, s: int) -> DataFrame:
        x = _predictors(others, levels)
        weight = poisson_weight(key, seed, s, c) if bootstrap else None
        draw = lambda i: F.element_at("__near", (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(s), F.lit(c), i), F.size("__near")) + 1).cast("int"))["v"]
        if c in levels:
            rows, xs, ys = _fitting_rows(now, x, c, key, weight, [(F.col(c) == v).cast("double") for v in levels[c][1:]])
            pred = _linear(x, np.r_[0.0, canonical(_gram(rows, [*xs, *ys], "__w"), len(xs))]) if xs and ys else F.lit(0.0)
            drawn = draw(F.lit(0))
        else:
            rows, xs, ys = _fitting_rows(now, x, c, key, weight, [F.col(c)])
            pred = _linear(x, _solve(_gram(rows, [*xs, *ys], "__w")))
            n = m if average else 1
            drawn = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw), F.lit(0.0), lambda a, b: a + b) / n
        return now.join(_donors(now, pred, c, key, k).select(key, drawn.alias("__new")), key, "left")

    return _chain(df, cols, sweeps, key, fill, levels)


def impute_multiple(df: DataFrame, cols: list[str], m: int, sweeps: int = 5, key: str = "row_id", seed: int = 500, k: int = 5) -> DataFrame:
    """m chained imputations by predictive mean matching, one below the other: column imputation from 1 to m."""
    parts = [impute_pmm(df, cols, 1, sweeps, key, seed + i, k).withColumn("imputation", F.lit(i + 1)) for i in range(m)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impute_chained(df: DataFrame, cols: list[str], method: str = "regression", sweeps: int = 2, key: str = "row_id", seed: int = 335, bootstrap: bool = False) -> DataFrame:
    """Chained imputation by regression, or by random forests of 10 trees.

    regression: a number becomes its linear prediction from the other columns; a label is drawn, by hash, with the
    probabilities of a multinomial logistic regression. bootstrap weights the fitting rows as impute_pmm does. forest: numeric
    columns only. A text column without a value stays as it is.
    """
    levels = _labels(df, cols)
    if method != "regression" and levels:
        raise ValueError("forests fill numeric columns only")

    def fill(now: DataFrame, others: list[str], c: str, s: int) -> DataFrame:
        if method == "regression":
            x = _predictors(others, levels)
            weight = poisson_weight(key, seed, s, c) if bootstrap else None
            if c not in levels:
                rows, xs, ys = _fitting_rows(now, x, c, key, weight, [F.col(c)])
                return now.withColumn("__new", _linear(x, _solve(_gram(rows, [*xs, *ys], "__w"))))
            if len(levels[c]) < 2:
                return now.withColumn("__new", F.lit(levels[c][0] if levels[c] else None).cast("string"))
            number = sum((F.when(F.col(c) == v, i).otherwise(0) for i, v in enumerate(levels[c])), F.lit(0))
            rows, xs, ys = _fitting_rows(now, x, c, key, weight, [number])
            rows = staged(rows, "fitting-rows")  # every step reads them
            beta = multinomial(rows, xs, ys[0], len(levels[c]), "__w")
            z = F.array(*[_linear(x, b) for b in beta])
            share = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
            u = (F.xxhash64(key, F.lit(seed), F.lit(s), F.lit(c)) / float(2**63) + 1) / 2
            at = now.withColumn("__share", share).withColumn("__left", u * F.aggregate("__share", F.lit(0.0), lambda a, b: a + b))
            upto = lambda i: F.aggregate(F.slice("__share", 1, i + 1), F.lit(0.0), lambda a, b: a + b)
            passed = F.size(F.filter(F.sequence(F.lit(0), F.lit(len(beta) - 2)), lambda i: upto(i) <= F.col("__left")))
            return at.withColumn("__new", F.get(F.array(*map(F.lit, levels[c])), passed)).drop("__share", "__left")
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import RandomForestRegressor

        rows = VectorAssembler(inputCols=others, outputCol="__x").transform(now)
        fitted = RandomForestRegressor(featuresCol="__x", labelCol=c, predictionCol="__new", numTrees=10, seed=500).fit(rows.where(~F.col(f"__miss_{c}")))
        return fitted.transform(rows).drop("__x")

    return _chain(df, cols, sweeps, key, fill, levels)


def impute_by_cluster(df: DataFrame, complete: list[str], targets: list[str], k: int = 5, sample: int = 1000, key: str = "row_id") -> DataFrame:
    """Rows are grouped on complete numeric columns (Ward on a bounded sample, then nearest centre); a missing
    number becomes the mean of its group, a missing label the mode."""
    from tarmac.operators.cluster import assign, ward_centres
    from tarmac.operators.neighbours import standardised
    from tarmac.operators.summary import is_numeric, mode_by

    z = standardised(df, complete, key)
    small = z.orderBy(order_of(key, 500), key).limit(sample).toPandas()
    groups = assign(z, ward_centres(small[complete].to_numpy(float), k), complete, key, "__group")
    out = df.join(groups.select(key, "__group"), key, "left")
    for c in targets:
        if is_numeric(df.schema[c].dataType):
            out = impute_group_mean(out, c, ["__group"])
        else:
            modes = mode_by(out, "__group", c, "__mode")
            out = out.join(F.broadcast(modes), "__group", "left")  # k rows
            out = out.withColumn(c, F.coalesce(F.col(c), F.col("__mode"))).drop("__mode")
    return out.drop("__group")


def impute_knn(df: DataFrame, target: str, num: list[str], cat: list[str], k: int = 5, key: str = "row_id") -> DataFrame:
    """The median (numbers) or most frequent value (labels, ties to the smaller) of the k donors nearest by mixed distance.

    Every row that has the value is a donor; equally near ones count in the order of their keys. Ranges are those of all rows.
    """
    from tarmac.operators.summary import is_numeric

    number = is_numeric(df.schema[target].dataType)
    near = nearest_mixed(df.where(F.col(target).isNull()), df.where(F.col(target).isNotNull()), num, cat, target, k, ranges_of(df, num), key)
    values = F.sort_array(F.transform("near", lambda x: x["value"]))
    if number:
        half = F.size(values) / 2
        new = (F.element_at(values, F.ceil(half).cast("int")) + F.element_at(values, F.floor(half + 1).cast("int"))).cast("double") / 2
    else:
        counted = F.transform(F.array_distinct(values), lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("v")))
        new = F.array_min(counted)["v"]
    return df.join(near.select(key, new.alias("__new")), key, "left").withColumn(target, F.coalesce(F.col(target), F.col("__new"))).drop("__new")


def compare_distribution(before: DataFrame, after: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, before, after): shares by equal bins of the observed range, or by level for labels."""
    from tarmac.operators.summary import is_numeric

    if is_numeric(before.schema[col].dataType):
        ends = before.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
        cut = lambda d: d.where(F.col(col).isNotNull()).crossJoin(F.broadcast(ends)).select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("lo"), (F.col("hi") - F.col("lo")) / bins), F.lit(0.0))))).cast("string").alias("bin"))
    else:
        cut = lambda d: d.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("bin"))
    share = lambda d, name: cut(d).groupBy("bin").count().withColumn(name, F.col("count") / F.sum("count").over(Window.partitionBy())).drop("count")
    return share(before, "before").join(share(after, "after"), "bin", "full").fillna(0.0, ["before", "after"])
