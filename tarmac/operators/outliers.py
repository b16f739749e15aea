"""Outlier detectors. Each returns (row_id, variable or nothing, method) of flagged rows; votes are joined by id."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.order import quantiles
from tarmac.functions.stats import chi2_quantile, chi2_sf
from tarmac.operators.neighbours import knn_join, standardised
from tarmac.operators.sampling import order_of
from tarmac.sources.stages import remove, stage_path, staged


def _long(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "variable", "value").where("value is not null")


def _beyond(df: DataFrame, cols: list[str], key: str, stats: DataFrame, lo: Column, hi: Column, method: str) -> DataFrame:
    """stats has a row per variable."""
    return _long(df, cols, key).join(F.broadcast(stats.select("variable", lo.alias("lo"), hi.alias("hi"))), "variable").where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).select(key, "variable", F.lit(method).alias("method"))


def outlier_iqr(df: DataFrame, cols: list[str], key: str = "row_id", k: float = 1.5) -> DataFrame:
    s = quantiles(_long(df, cols, key), ["variable"], "value", {"a": 0.25, "b": 0.75})
    gap = (F.col("b") - F.col("a")) * k
    return _beyond(df, cols, key, s, F.col("a") - gap, F.col("b") + gap, "iqr")


def outlier_zscore(df: DataFrame, cols: list[str], key: str = "row_id", k: float = 3.0) -> DataFrame:
    s = _long(df, cols, key).groupBy("variable").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return _beyond(df, cols, key, s, F.col("m") - k * F.col("s"), F.col("m") + k * F.col("s"), "zscore")


def outlier_hampel(df: DataFrame, cols: list[str], key: str = "row_id", k: float = 3.0) -> DataFrame:
    """Beyond median ± k * 1.4826 * MAD."""
    counts = staged(_long(df, cols, key).groupBy("variable", "value").agg(F.count("*").alias("times")), "value-counts")
    m = staged(quantiles(counts, ["variable"], "value", {"m": 0.5}, "times"), "medians")  # a row for each variable
    s = quantiles(counts.join(F.broadcast(m), "variable"), ["variable"], F.abs(F.col("value") - F.col("m")), {"d": 0.5}, "times").join(m, "variable")
    return _beyond(df, cols, key, s, F.col("m") - k * 1.4826 * F.col("d"), F.col("m") + k * 1.4826 * F.col("d"), "hampel")


def outlier_counts(*flags: DataFrame) -> DataFrame:
    """(variable, method, n)."""
    return reduce(lambda a, b: a.unionByName(b), flags).groupBy("variable", "method").agg(F.count("*").alias("n"))


def _moments(cols: list[str]) -> list[Column]:
    return [*[F.avg(c) for c in cols], *[F.covar_samp(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]]


def _read_moments(r: list, p: int) -> tuple[np.ndarray, np.ndarray]:
    cov = np.zeros((p, p))
    for (i, j), v in zip(((i, j) for i in range(p) for j in range(i, p)), r[p:], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return np.array([x or 0.0 for x in r[:p]]), cov


def moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of complete rows, in one aggregate."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    return _read_moments(list(d.agg(*_moments(cols)).first()), len(cols))


def mahalanobis(cols: list[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared distance as a column expression."""
    inv = np.linalg.pinv(cov)
    d = [F.col(c) - float(m) for c, m in zip(cols, mean, strict=True)]
    return reduce(lambda a, b: a + b, [d[i] * d[j] * float(inv[i, j] * (1 if i == j else 2)) for i in range(len(cols)) for j in range(i, len(cols))])


def outlier_mahalanobis(df: DataFrame, cols: list[str], key: str = "row_id", q: float = 0.99) -> DataFrame:
    """Squared distance beyond the chi-square quantile; rows with nulls aren't judged."""
    mean, cov = moments(df, cols)
    return df.dropna(subset=cols).where(mahalanobis(cols, mean, cov) > chi2_quantile(q, len(cols))).select(key, F.lit("mahalanobis").alias("method"))


def _scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    cov = np.cov(x, rowvar=False).reshape(x.shape[1], -1)
    return x.mean(0), cov, float(np.linalg.slogdet(cov + 1e-12 * np.eye(x.shape[1]))[1])


def _starts(x: np.ndarray, support: float, n_starts: int, keep: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and covariances of the smallest determinants on a sample, from random subsets and concentration steps."""
    rng, h, found = np.random.default_rng(seed), max(int(np.ceil(support * len(x))), x.shape[1] + 1), []

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        d = x - mean
        return _scatter(x[np.argsort(((d @ np.linalg.pinv(cov)) * d).sum(1), kind="stable")[:h]])

    for _ in range(n_starts):
        at = _scatter(x[rng.choice(len(x), x.shape[1] + 1, replace=False)])
        for _ in range(2):
            at = step(*at[:2])
        found.append(at)
    found = sorted(found, key=lambda f: f[2])[: 3 * keep]
    for _ in range(10):
        found = [step(*f[:2]) for f in found]
    return [f[:2] for f in sorted(found, key=lambda f: f[2])[:keep]]


def _distances(x: np.ndarray, mean: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Squared distances by products of columns: a row has the same in each scan, whatever its batch is."""
    p, c = x.shape[1], [x[:, i] - mean[i] for i in range(x.shape[1])]
    return reduce(lambda a, b: a + b, [c[i] * c[j] * float(inv[i, j] * (1 if i == j else 2)) for i in range(p) for j in range(i, p)])


def _concentrated(d: DataFrame, cols: list[str], fits: dict[int, tuple[np.ndarray, np.ndarray]], h: int, small: np.ndarray, support: float, bins: int = 4096, few: int = 20_000) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centres and covariances of the h rows nearest to each fit, with those as far as the last of them; exact, in two scans mostly.

    A scan counts squared distances in `bins` bins between bounds that are read from the sample, and beyond them; the next ones narrow the
    bin of the hth row, until it holds `few` rows or one distance. The last scan sums the rows below that bin and hands its rows to the driver.
    """
    spark, p = d.sparkSession, len(cols)
    at = {i: (mean, np.linalg.pinv(cov)) for i, (mean, cov) in fits.items()}
    bound = {i: [float(v) for v in np.quantile(_distances(small, *at[i]), [max(0.0, support - 0.06), min(1.0, support + 0.06)])] for i in at}
    todo = set(at)
    while todo:
        held = spark.sparkContext.broadcast((at, {i: bound[i] for i in todo}))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, bound = held.value
            found = {i: (np.zeros(bins + 2, np.int64), np.full(bins + 2, np.inf), np.full(bins + 2, -np.inf)) for i in bound}
            for pdf in batches:
                x = pdf[cols].to_numpy(float)
                for i, (lo, hi) in bound.items():
                    v, (n, low, high) = _distances(x, *at[i]), found[i]
                    scaled = np.clip((v - lo) / (hi - lo) if hi > lo else np.zeros(len(v)), 0, 1) * bins
                    b = np.where(v < lo, 0, np.where(v > hi, bins + 1, 1 + np.minimum(scaled.astype(int), bins - 1)))
                    n += np.bincount(b, minlength=bins + 2)
                    np.minimum.at(low, b, v)
                    np.maximum.at(high, b, v)
            for i, (n, low, high) in found.items():
                b = np.flatnonzero(n)
                yield pd.DataFrame({"i": i, "b": b, "n": n[b], "lo": low[b], "hi": high[b]})

        got = d.select(*cols).mapInPandas(count, "i int, b int, n long, lo double, hi double").groupBy("i", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values("b")
        for i in list(todo):
            mine = got[got.i == i]
            last = mine.iloc[int((mine.n.cumsum() < h).sum())]  # the bin of the hth row
            bound[i] = [float(last.lo), float(last.hi)]
            if last.n <= few or last.lo == last.hi:
                todo.remove(i)
        held.unpersist()
    held = spark.sparkContext.broadcast((at, bound))

    def add(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        c = np.column_stack([np.ones(len(x)), x - mean])
        return (c.T @ c).ravel()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bound = held.value
        total = {i: np.zeros((p + 1) ** 2) for i in at}
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            for i, (lo, hi) in bound.items():
                v = _distances(x, *at[i])
                total[i] += add(x[v < lo] if lo < hi else x[v <= lo], at[i][0])
                if lo < hi:
                    rest = x[(v >= lo) & (v <= hi)]
                if lo < hi and len(rest):
                    yield pd.DataFrame({"i": i, "row": True, "x": list(rest)})
        for i, t in total.items():
            yield pd.DataFrame({"i": [i], "row": False, "x": [t]})

    got = d.select(*cols).mapInPandas(sums, "i int, row boolean, x array<double>").toPandas()  # the sums of each task, and `few` rows
    out = {}
    for i, (mean, _) in at.items():
        mine = got[got.i == i]
        total = np.sum([t for t in mine.x[~mine.row]], axis=0)
        rest = np.array(mine.x[mine.row].tolist(), float).reshape(-1, p)
        if len(rest):
            v = _distances(rest, *at[i])
            total = total + add(rest[v <= np.partition(v, h - round(total[0]) - 1)[h - round(total[0]) - 1]], mean)
        total = total.reshape(p + 1, p + 1)
        n, s = total[0, 0], total[0, 1:]
        out[i] = (mean + s / n, (total[1:, 1:] - np.outer(s, s) / n) / (n - 1))
    held.unpersist()
    return out


def outlier_robust(df: DataFrame, cols: list[str], key: str = "row_id", support: float = 0.75, q: float = 0.99, rounds: int = 10, starts: int = 100, sample: int = 1500, keep: int = 2, seed: int = 1) -> DataFrame:
    """The same around a minimum-covariance-determinant centre.

    `starts` random subsets compete on a hash sample of `sample` rows; the best `keep` of them, and medians with
    absolute deviations, go on together with concentration steps on all rows, each keeping the share `support` of
    nearest rows, exactly (with those as far as the last of them). The smallest determinant counts.
    """
    d = staged(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols), "robust")
    p = len(cols)
    small = d.orderBy(order_of(key, seed), key).limit(sample).toPandas()[cols].to_numpy(float)
    if len(small) <= p + 1:
        return d.limit(0).select(key, F.lit("robust").alias("method"))
    long = d.unpivot([key], cols, "variable", "value")
    med = {r.variable: r.m for r in quantiles(long, ["variable"], "value", {"m": 0.5}).collect()}
    centred = F.abs(F.col("value") - F.create_map(*[F.lit(x) for c in cols for x in (c, float(med[c]))])[F.col("variable")])
    mad = {r.variable: r.m for r in quantiles(long, ["variable"], centred, {"m": 0.5}).collect()}
    scale = np.array([1.4826 * mad[c] for c in cols])
    fits = [(np.array([med[c] for c in cols]), np.diag(np.where(scale > 0, scale**2, 1.0))), *_starts(small, support, starts, keep, seed)]
    size = lambda cov: float(np.linalg.slogdet(cov + 1e-12 * np.eye(p))[1])
    live, h = {i: np.inf for i in range(len(fits))}, math.ceil(support * d.count())
    for _ in range(rounds):
        for i, fit in _concentrated(d, cols, {i: fits[i] for i in live}, h, small, support).items():
            fits[i] = fit
        now = {i: size(fits[i][1]) for i in live}
        live = {i: det for i, det in now.items() if not abs(live[i] - det) < 1e-9}
        if not live:
            break
    best = min(fits, key=lambda f: size(f[1]))
    # the covariance of the central share is widened to that of all rows of a normal sample
    factor = support / (1 - chi2_sf(chi2_quantile(support, p), p + 2))
    return d.where(mahalanobis(cols, best[0], best[1] * factor) > chi2_quantile(q, p)).select(key, F.lit("robust").alias("method"))


def outlier_knn(df: DataFrame, cols: list[str], key: str = "row_id", k: int = 1, top_n: int = 200) -> DataFrame:
    """The top_n rows farthest from their kth neighbour among all standardised rows."""
    z = standardised(df, cols, key)
    near = knn_join(z, z, cols, k, key)
    return near.where(F.col("rank") == k).orderBy(F.desc("distance"), key).limit(top_n).select(key, "distance", F.lit("knn").alias("method"))


def lof_scores(df: DataFrame, cols: list[str], key: str = "row_id", k: int = 5, scale: bool = True) -> DataFrame:
    """(row_id, lof): local outlier factor among all rows.

    Distances of 0 among copies give a reachability of 0; a density is then capped, so copies score 1.
    """
    z = standardised(df, cols, key) if scale else df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    near = staged(knn_join(z, z, cols, k, key), "neighbours")
    kdist = near.groupBy(key).agg(F.max("distance").alias("kdist")).withColumnRenamed(key, "neighbour")
    lrd = staged(near.join(kdist, "neighbour").groupBy(key).agg((1 / F.greatest(F.avg(F.greatest("distance", "kdist")), F.lit(1e-10))).alias("lrd")), "densities")
    of = lrd.select(F.col(key).alias("neighbour"), F.col("lrd").alias("nlrd"))
    return near.join(of, "neighbour").groupBy(key).agg(F.avg("nlrd").alias("nlrd")).join(lrd, key).select(key, (F.col("nlrd") / F.col("lrd")).alias("lof"))


def outlier_lof(df: DataFrame, cols: list[str], key: str = "row_id", k: int = 5, cut: float = 2.0, scale: bool = True) -> DataFrame:
    return lof_scores(df, cols, key, k, scale).where(F.col("lof") > cut).select(key, F.lit("lof").alias("method"))


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) < 2:
        return (len(x),)
    spread = np.flatnonzero(x.max(0) > x.min(0))
    if not len(spread):
        return (len(x),)
    c = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    left = x[:, c] < cut
    return (c, cut, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1))


def _rest(n: float) -> float:
    """Expected depth still to go in a leaf of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree: tuple, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += depth + _rest(tree[0])
        return
    left = x[at, tree[0]] < tree[1]
    _depths(tree[2], x, at[left], depth + 1, out)
    _depths(tree[3], x, at[~left], depth + 1, out)


def iforest_depths(df: DataFrame, cols: list[str], key: str = "row_id", trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """(row_id, depth): mean isolation depth over trees, each grown on its own sample of `sample` rows.

    Trees are grown in Spark, one group each, broadcast (their size doesn't depend on the data), and used in one scan.
    """
    d = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    spark = df.sparkSession
    # a row draws a tree number `draws` times, each with a chance; a tree gets 3 times the rows that it takes, on average
    rate = 3.0 * sample * trees / max(d.count(), 1)
    draws = min(max(1, int(np.ceil(rate))), 3 * trees)
    hashed = lambda salt: F.pmod(F.xxhash64(key, "draw", F.lit(seed), F.lit(salt)), F.lit(1 << 30))
    drawn = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).where(hashed(0) / float(1 << 30) < rate / draws)
    picked = drawn.withColumn("tree", hashed(1) % trees).groupBy(key, "tree").agg(*[F.first(c).alias(c) for c in cols]).withColumn("u", F.xxhash64(key, "tree", F.lit(seed)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        x = pdf.sort_values(["u", key]).head(sample)[cols].to_numpy()
        rng = np.random.default_rng(seed + int(pdf.tree.iloc[0]))
        return pd.DataFrame({"tree": [pickle.dumps(_tree(x, rng, int(np.ceil(np.log2(max(len(x), 2))))))]})

    import pickle

    grown = [pickle.loads(r.tree) for r in picked.groupBy("tree").applyInPandas(grow, "tree binary").collect()]
    held = spark.sparkContext.broadcast(grown)

    def run(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            out = np.zeros(len(x))
            for tree in held.value:
                _depths(tree, x, np.arange(len(x)), 0, out)
            yield pd.DataFrame({key: pdf[key], "depth": out / max(len(held.value), 1)})

    return d.mapInPandas(run, f"{key} {dict(d.dtypes)[key]}, depth double")


def iforest_depths_by_level(df: DataFrame, cols: list[str], key: str = "row_id", trees: int = 500, share: float = 0.5, seed: int = 123, at_once: int = 20) -> DataFrame:
    """(row_id, depth): mean isolation depth over trees grown on `share` of the rows each, drawn with replacement.

    Trees of that size are as large as the table, so they are grown in Spark, a level at a time, and never held anywhere: a
    row has a node in each tree, and how often it was drawn there (a Poisson number by hash). The drawn rows of a node give minima and maxima; a column
    that isn't constant and a place between its ends are chosen by hash, and all rows of the node go to one side. A node of one drawn row, of equal
    ones, or at depth log2(share * rows) is a leaf, and its rows get its depth and what is to be expected below. `at_once` trees grow
    together; a level is written, and the one before goes.
    """
    spark, names = df.sparkSession, [f"__x{j}" for j in range(len(cols))]
    base = staged(df.select(F.col(key).alias("__key"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names, strict=True)]).dropna(subset=names), "forest-rows")
    most = max(1, int(np.ceil(np.log2(max(2.0, share * base.count())))))
    u = lambda *salt: (F.xxhash64(*salt, F.lit(seed)) / float(2**63) + 1) / 2
    done = None
    for a in range(0, trees, at_once):
        group = [F.lit(t) for t in range(a, min(trees, a + at_once))]
        state = base.withColumn("tree", F.explode(F.array(*group))).withColumns({"node": F.lit(1).cast("long"), "w": _poisson(u("__key", "tree", F.lit("draw")), share)})
        parts, before = [], None
        for depth in range(most + 1):
            drawn = state.where("w > 0").groupBy("tree", "node").agg(F.sum("w").cast("double").alias("n"), *[f(n).alias(f"{kind}{n}") for n in names for kind, f in (("lo", F.min), ("hi", F.max))])
            wide = F.filter(F.array(*[F.when(F.col(f"hi{n}") > F.col(f"lo{n}"), F.struct(F.lit(j).alias("j"), F.col(f"lo{n}").alias("lo"), F.col(f"hi{n}").alias("hi"))) for j, n in enumerate(names)]), lambda x: x.isNotNull())
            chosen = F.get(F.col("wide"), F.floor(u("tree", "node", F.lit("column")) * F.size("wide")).cast("int"))
            nodes = drawn.select("tree", "node", "n", wide.alias("wide")).withColumn("c", F.when((F.col("n") > 1) & (F.lit(depth) < most), chosen))
            nodes = nodes.select("tree", "node", "n", F.col("c.j").alias("j"), (F.col("c.lo") + u("tree", "node", F.lit("cut")) * (F.col("c.hi") - F.col("c.lo"))).alias("cut"))
            # a side without drawn rows is a leaf without rows
            now = state.join(nodes, ["tree", "node"], "left")
            x = F.get(F.array(*names), F.col("j"))
            rest = F.when(F.col("n") >= 2, 2 * (F.log(F.col("n") - 1) + 0.5772156649) - 2 * (F.col("n") - 1) / F.col("n")).otherwise(0.0)
            path = stage_path(spark, "forest-level")
            now.select("__key", *names, "tree", (2 * F.col("node") + F.when(x < F.col("cut"), 0).otherwise(1)).alias("node"), "w", F.when(F.col("j").isNull(), F.coalesce(rest, F.lit(0.0)) + depth).alias("depth")).write.parquet(path)
            level = spark.read.parquet(path)
            ended = staged(level.where("depth is not null").groupBy("__key").agg(F.sum("depth").alias("depth"), F.count("*").alias("n")), "forest-depths")
            parts.append(ended)
            state = level.where("depth is null").drop("depth")
            if before:
                remove(spark, before)
            before = path
            if state.isEmpty():
                break
        remove(spark, before)
        total = parts[0]
        for p in [*parts[1:], *([done] if done is not None else [])]:
            total = total.unionByName(p)
        done = staged(total.groupBy("__key").agg(F.sum("depth").alias("depth"), F.sum("n").alias("n")), "forest-depths")
    return done.select(F.col("__key").alias(key), (F.col("depth") / F.col("n")).alias("depth"))


def _poisson(u: Column, mean: float) -> Column:
    """A Poisson number of the given mean from one that is uniform between 0 and 1."""
    at, step = [], float(np.exp(-mean))
    total = step
    for n in range(1, 13):
        at.append(total)
        step *= mean / n
        total += step
    return sum(((u >= a).cast("int") for a in at), F.lit(0))


def outlier_iforest(df: DataFrame, cols: list[str], key: str = "row_id", rule: float | str = "p10", share: float | None = None, **how) -> DataFrame:
    """Rows of a mean depth at or below the 10th percentile, or below a given depth.

    Trees are grown on samples of fixed size, or, with share, on that share of the rows each (the study: 500 trees, share 0.5).
    """
    depths = staged(iforest_depths_by_level(df, cols, key, share=share, **how) if share else iforest_depths(df, cols, key, **how), "depths")
    if rule == "p10":
        cut = quantiles(depths, [], "depth", {"cut": 0.1}).first().cut
        return depths.where(F.col("depth") <= cut).select(key, F.lit("iforest").alias("method")) if cut is not None else depths.limit(0).select(key, F.lit("iforest").alias("method"))
    return depths.where(F.col("depth") < float(rule)).select(key, F.lit("iforest").alias("method"))


def extremes(df: DataFrame, score: str, n: int, key: str = "row_id", lowest: bool = False) -> DataFrame:
    return df.orderBy(F.asc(score) if lowest else F.desc(score), key).limit(n)


def votes(flags: list[DataFrame], key: str = "row_id") -> DataFrame:
    """(row_id, votes): by how many methods a row is flagged; flags of several variables count once."""
    return reduce(lambda a, b: a.union(b), [f.select(key, "method") for f in flags]).distinct().groupBy(key).agg(F.count("*").alias("votes"))


def consensus(flags: list[DataFrame], min_votes: int = 2, key: str = "row_id") -> DataFrame:
    return votes(flags, key).where(F.col("votes") >= min_votes)


def vote_distribution(v: DataFrame) -> DataFrame:
    return v.groupBy("votes").agg(F.count("*").alias("n"))


def remove_anomalies(df: DataFrame, agreed: DataFrame, rule: Column, key: str = "row_id") -> DataFrame:
    """Without the agreed outliers that also break a domain rule."""
    bad = df.join(agreed.select(key), key, "left_semi").where(rule).select(key)
    return df.join(bad, key, "left_anti")
