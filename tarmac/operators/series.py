"""Monthly series: counting, features, and clustering by dynamic time warping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tarmac.operators.cluster import linkage
from tarmac.sources.stages import remove, stage_path, staged


def monthly_series(df: DataFrame, key: str, period: str, min_months: int = 6) -> DataFrame:
    """(key, period, total) with zeros for missing months; series of fewer than min_months active ones go."""
    counts = df.where(F.col(key).isNotNull() & F.col(period).isNotNull()).groupBy(key, period).agg(F.count("*").alias("total"))
    active = counts.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") >= min_months).select(key)
    grid = active.crossJoin(counts.select(period).distinct())
    return grid.join(counts, [key, period], "left").fillna(0, ["total"])


def series_features(long: DataFrame, key: str, period: str) -> DataFrame:
    """total, mean, sd, max, active months and share, mean of non-zero, peak over mean, slope over the index."""
    months = long.select(period).distinct().withColumn("i", F.row_number().over(Window.orderBy(period)))
    t = F.col("total")
    g = long.join(months, period).groupBy(key).agg(F.sum("total").alias("total_sum"), F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), F.max("total").alias("max"), F.count_if(t > 0).alias("active"), (F.count_if(t > 0) / F.count("*")).alias("active_share"), F.avg(F.when(t > 0, t)).alias("mean_nonzero"), F.regr_slope(t.cast("double"), F.col("i").cast("double")).alias("slope"))
    return g.withColumn("peak_ratio", F.try_divide(F.col("max"), F.col("mean")))


def cluster_period_profile(long: DataFrame, labels: DataFrame, key: str, period: str, cols: list[str]) -> DataFrame:
    return long.join(labels, key).groupBy("cluster", period).agg(*[F.avg(c).alias(c) for c in cols])


def dtw(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Cumulative distance with diagonal steps weighted 2, not normalised; window bounds |i - j|."""
    n, m = len(a), len(b)
    w = max(window, abs(n - m)) if window is not None else max(n, m)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            c = abs(a[i - 1] - b[j - 1])
            first = i == 1 and j == 1
            d[i, j] = c if first else min(d[i - 1, j] + c, d[i, j - 1] + c, d[i - 1, j - 1] + 2 * c)
    return float(d[n, m])


def dtw_pairs(long: DataFrame, key: str, period: str, value: str, window: int | None = None) -> DataFrame:
    """(i, j, d) for all pairs of series, i < j. Pairs are dealt evenly; series are as short as there are periods."""
    arrays = long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(period, F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("s"))
    a, b = (arrays.select(F.col(key).alias(n), F.col("s").alias(f"s_{n}")) for n in "ij")
    pairs = a.join(b, F.col("i") < F.col("j")).repartition(long.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"i": pdf.i, "j": pdf.j, "d": [dtw(x, y, window) for x, y in zip(pdf.s_i, pdf.s_j, strict=True)]})

    kind = dict(long.dtypes)[key]
    return pairs.mapInPandas(run, f"i {kind}, j {kind}, d double")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a table in the shared folder, and where, for the caller to remove."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def hierarchy(pairs: DataFrame, method: str = "ward", few: int = 1000) -> DataFrame:
    """(item, into, height, step): a cluster bears its smallest item's name, so every other item is absorbed once.

    pairs: (i, j, d), every pair of items once, each way round. Ward updates squares (heights are distances again),
    average takes the mean distance; ties go to the smaller names. Each round merges, over the whole table of pairs,
    all clusters that are nearest to each other: both linkages never bring a third cluster nearer than that, so the tree
    is the one that single merges give, but for ties. The last `few` clusters are merged on the driver. Heights never
    fall on the way up. A pair that is missing or has no distance is refused.
    """
    ward, spark = method == "ward", pairs.sparkSession
    one = lambda c: F.struct(F.col(c).alias("c"), F.lit(1.0).alias("n"), F.lit(0.0).alias("top"), F.lit(0.0).alias("w"))
    d = F.col("d").cast("double")
    first = pairs.where(d.isNotNull() & ~F.isnan(d)).select(F.least(one("i"), one("j")).alias("lo"), F.greatest(one("i"), one("j")).alias("hi"), (d * d if ward else d).alias("e"))
    near, path = _written(first, "cluster-pairs")
    items = near.select(F.explode(F.array("lo.c", "hi.c")).alias("c")).distinct().count()
    if 2 * near.count() != items * (items - 1) or 2 * pairs.count() != items * (items - 1):
        raise ValueError("the table lacks pairs, repeats some or has some without a distance")
    kind, trees, made, step = near.schema["lo"].dataType["c"].dataType.simpleString(), [], [], 0
    far = 2 * F.col("lo.n") * F.col("hi.n") / (F.col("lo.n") + F.col("hi.n")) * F.col("e") if ward else F.col("e")
    while items > max(few, 1):
        step += 1
        ranked = near.select(F.struct(far.alias("far"), "lo", "hi", "e").alias("p"))
        best = ranked.select("p", F.explode(F.array("p.lo.c", "p.hi.c")).alias("c")).groupBy("c").agg(F.min("p").alias("p"))
        met = best.groupBy("p").count().where("count = 2").select("p.*", F.greatest(F.sqrt(F.greatest("p.far", F.lit(0.0))) if ward else F.col("p.far"), "p.lo.top", "p.hi.top").alias("height"))
        met, at = _written(met, "merges")
        made.append(at)
        trees.append(met.select(F.col("hi.c").alias("item"), F.col("lo.c").alias("into"), "height", F.lit(step).alias("step")))
        items -= met.count()
        n = F.col("lo.n") + F.col("hi.n")
        merged = F.struct(F.col("lo.c").alias("c"), n.alias("n"), F.col("height").alias("top"), (F.col("lo.n") * F.col("hi.n") / (n * n) * F.col("e") if ward else F.lit(0.0)).alias("w"))
        moved = met.select(F.explode(F.array(*[F.struct(F.col(f"{s}.c").alias("c"), merged.alias("m"), (F.col(f"{s}.n") / n).alias("share")) for s in ("lo", "hi")])).alias("x")).select("x.*")
        out = near
        for s in ("lo", "hi"):
            out = out.join(moved.toDF(f"__{s}", f"m_{s}", f"share_{s}"), F.col(f"{s}.c") == F.col(f"__{s}"), "left")
            same = F.struct(F.col(f"{s}.c").alias("c"), F.col(f"{s}.n").alias("n"), F.col(f"{s}.top").alias("top"), F.lit(0.0).alias("w"))
            out = out.withColumn(f"new_{s}", F.coalesce(f"m_{s}", same)).withColumn(f"share_{s}", F.coalesce(f"share_{s}", F.lit(1.0)))
        out = out.where(F.col("new_lo.c") != F.col("new_hi.c"))
        out = out.groupBy(F.least("new_lo", "new_hi").alias("lo"), F.greatest("new_lo", "new_hi").alias("hi")).agg(F.sum(F.col("e") * F.col("share_lo") * F.col("share_hi")).alias("e"))
        out = out.select("lo", "hi", (F.col("e") - F.col("lo.w") - F.col("hi.w")).alias("e"))
        last = path
        near, path = _written(out, "cluster-pairs")
        remove(spark, last)
    rest = near.select(F.col("lo.c").alias("i"), F.col("hi.c").alias("j"), F.col("lo.n").alias("ni"), F.col("hi.n").alias("nj"), F.col("lo.top").alias("ti"), F.col("hi.top").alias("tj"), (F.sqrt(F.greatest(far, F.lit(0.0))) if ward else far).alias("d")).collect()
    remove(spark, path)
    trees.append(spark.createDataFrame(_last_merges(rest, method, step), f"item {kind}, into {kind}, height double, step int"))
    tree = staged(reduce(DataFrame.union, trees), "hierarchy")
    remove(spark, *made)
    return tree


def _last_merges(rest: list, method: str, step: int) -> list[tuple]:
    known = {r.i: (r.ni, r.ti) for r in rest} | {r.j: (r.nj, r.tj) for r in rest}
    names = sorted(known)
    at, d = {c: n for n, c in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rest:
        d[at[r.i], at[r.j]] = d[at[r.j], at[r.i]] = r.d
    name, top, out = list(names), [known[c][1] for c in names], []
    for s, (a, b, height, _) in enumerate(linkage(d, method, np.array([known[c][0] for c in names]))):
        into, item = sorted((name[a], name[b]))
        name.append(into)
        top.append(max(height, top[a], top[b]))
        out.append((item, into, top[-1], step + s + 1))
    return out


def ascents(tree: DataFrame) -> DataFrame:
    """(item, up): the mergers {height, step, item, into} that an item goes through, rising, by doubling.

    up: those in which the cluster's name changes for the item; empty for the smallest item of all.
    """
    hops = tree.select("item", F.array(F.struct("height", "step", "item", "into")).alias("up"), F.col("into").alias("at"))
    root = tree.join(tree.select(F.col("item").alias("into")), "into", "left_anti").select(F.col("into").alias("item")).distinct()
    up, path = _written(hops.union(root.select("item", F.array().cast(hops.schema["up"].dataType), "item")), "ascents")
    while not up.join(up.where(F.size("up") > 0).select(F.col("item").alias("at")), "at", "left_semi").isEmpty():
        further = up.select(F.col("item").alias("at"), F.col("up").alias("more"), F.col("at").alias("end"))
        last = path
        up, path = _written(up.join(further, "at").select("item", F.concat("up", "more").alias("up"), F.col("end").alias("at")), "ascents")
        remove(tree.sparkSession, last)
    return up.select("item", "up")


def _below(row: Row) -> Callable[[Column], Column]:
    limit = F.struct(F.lit(row.height).alias("height"), F.lit(row.step).cast("int").alias("step"), F.lit(row["item"]).alias("item"))
    return lambda x: F.struct(x["height"].alias("height"), x["step"].alias("step"), x["item"].alias("item")) < limit


def series_hclust(pairs: DataFrame, ks: list[int], method: str = "ward", few: int = 1000) -> DataFrame:
    """(k, key, cluster) by hierarchical grouping of the distance table, larger clusters first; a k above the number of
    series gives no rows. Ward on warping distances isn't a variance criterion; average linkage is the other choice."""
    tree = hierarchy(pairs, method, few)
    n = tree.count() + 1
    high = tree.orderBy(F.desc("height"), F.desc("step"), F.desc("item")).limit(max([*ks, 2]) - 1).collect()
    up, parts = ascents(tree), []
    for k in ks:
        if not 1 <= k <= n or n == 1:
            continue
        low = F.col("up")
        if k > 1:
            low = F.filter("up", _below(high[k - 2]))
        parts.append(up.select(F.lit(k).alias("k"), F.col("item").alias("key"), F.coalesce(F.try_element_at(low, F.lit(-1))["into"], F.col("item")).alias("root")))
    kind = dict(tree.dtypes)["item"]
    if not parts:
        return pairs.sparkSession.createDataFrame([], f"k int, key {kind}, cluster int")
    rows = reduce(DataFrame.union, parts)
    labels = rows.groupBy("k", "root").count().withColumn("cluster", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("count"), "root")) - 1)
    return rows.join(labels, ["k", "root"]).select("k", "key", "cluster")


def series_pam(pairs: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(key, cluster): medoids by alternating assignment and update on the pair table; starts from the series
    of the least summed distance, then the farthest in turn. Ties to the smaller key."""
    both = pairs.select("i", "j", "d").union(pairs.select("j", "i", "d")).union(pairs.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"))).union(pairs.select("j", F.col("j"), F.lit(0.0))).distinct().toDF("x", "m", "d").cache()
    medoids = [both.groupBy("x").agg(F.sum("d").alias("s")).orderBy("s", "x").first().x]
    while len(medoids) < k:
        far = both.where(F.col("m").isin(medoids)).groupBy("x").agg(F.min("d").alias("d")).orderBy(F.desc("d"), "x").first()
        medoids.append(far.x)
    for _ in range(rounds):
        near = both.where(F.col("m").isin(medoids)).groupBy("x").agg(F.min(F.struct("d", "m")).alias("b")).select("x", F.col("b.m").alias("medoid"))
        inside = both.join(near.select("x", "medoid"), "x").join(near.select(F.col("x").alias("m"), F.col("medoid").alias("__o")), "m").where(F.col("medoid") == F.col("__o"))
        cost = inside.groupBy("medoid", F.col("m").alias("candidate")).agg(F.sum("d").alias("s"))
        new = sorted(r.b.candidate for r in cost.groupBy("medoid").agg(F.min(F.struct("s", "candidate")).alias("b")).collect())
        if new == sorted(medoids):
            break
        medoids = new
    near = both.where(F.col("m").isin(medoids)).groupBy("x").agg(F.min(F.struct("d", "m")).alias("b"))
    names = F.create_map(*[F.lit(v) for i, m in enumerate(sorted(medoids)) for v in (m, i)])
    return near.select(F.col("x").alias("key"), names[F.col("b.m")].alias("cluster"))


def cophenetic(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs with `height`: that of the merger which first brings the two items of a pair together."""
    up = ascents(tree)
    names = F.concat(F.array("item"), F.col("up.into"))
    heights = F.concat(F.array(F.lit(0.0)), F.col("up.height"))
    side = lambda s: up.select(F.col("item").alias(s), names.alias(f"names_{s}"), heights.alias(f"heights_{s}"))
    both = pairs.join(side("i"), "i").join(side("j"), "j").withColumn("meet", F.array_intersect("names_i", "names_j")[0])
    at = lambda s: F.element_at(f"heights_{s}", F.array_position(f"names_{s}", F.col("meet")).cast("int"))
    return both.withColumn("height", F.greatest(at("i"), at("j"))).select(*pairs.columns, "height")


def ts_metrics(pairs: DataFrame, labels: dict[tuple[str, int], DataFrame], trees: dict[str, str] | None = None, few: int = 1000) -> DataFrame:
    """(method, k, silhouette, min_prop, imbalance, cophenetic) of labellings {(method, k): (key, cluster)}.

    trees: the linkage of those methods that are hierarchies, whose distances are correlated with the heights at which
    two series come together; null for others, and where either doesn't vary. A series alone in its cluster, and any
    where there is one cluster only, has silhouette 0. All of it is aggregation over the table of pairs.
    """
    spark = pairs.sparkSession
    labelled = reduce(DataFrame.union, [lab.select(F.lit(method).alias("method"), F.lit(k).alias("k"), "key", "cluster") for (method, k), lab in labels.items()])
    labelled = staged(labelled, "labels")
    both = pairs.select(F.col("i").alias("x"), F.col("j").alias("key"), "d").union(pairs.select("j", "i", "d"))
    means = both.join(labelled, "key").groupBy("method", "k", "x", "cluster").agg(F.avg("d").alias("mean"))
    own = labelled.select("method", "k", F.col("key").alias("x"), F.col("cluster").alias("own"))
    mine, other = F.max(F.when(F.col("cluster") == F.col("own"), F.col("mean"))), F.min(F.when(F.col("cluster") != F.col("own"), F.col("mean")))
    rows = means.join(own, ["method", "k", "x"]).groupBy("method", "k", "x").agg(mine.alias("a"), other.alias("b"))
    score = rows.groupBy("method", "k").agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))
    sizes = labelled.groupBy("method", "k", "cluster").count().groupBy("method", "k").agg((F.min("count") / F.sum("count")).alias("min_prop"), (F.max("count") / F.min("count")).alias("imbalance"))
    fits = []
    for method, link in (trees or {}).items():
        r = cophenetic(pairs, hierarchy(pairs, link, few)).agg(F.corr("d", "height").alias("fit")).first()
        fits.append((method, r.fit if r.fit is not None and np.isfinite(r.fit) else None))
    fit = spark.createDataFrame(fits, "method string, cophenetic double")
    return sizes.join(score, ["method", "k"], "left").fillna(0.0, ["silhouette"]).join(fit, "method", "left").select("method", "k", "silhouette", "min_prop", "imbalance", "cophenetic")
