"""Ranks, running sums and quantiles beyond what the range sampler sees whole, and neighbours, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.functions import order, stats
from tarmac.functions.order import avg_rank, cumulative, quantiles
from tarmac.operators import association, impute, inference, neighbours, outliers
from tarmac.sources import stages

N = 600_000


@pytest.fixture(params=["true", "false"])
def wide(spark, request):
    """32 shuffle partitions, with and without coalescing."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def numbers(spark):
    """x and y with ties, a hot value of x, a payload; also as pandas."""
    h = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1_000_003))
    df = spark.range(N).select(F.col("id").alias("row_id"), F.when(h(1) % 3 == 0, 7.0).otherwise((h(2) % 50_000).cast("double")).alias("x"), h(3).cast("double").alias("y"), (F.col("id") % 3).alias("g"), F.repeat(F.lit("p"), 20).alias("payload"))
    return df, df.drop("payload").toPandas()


def test_cumulative_of_many_rows(wide):
    df, pdf = numbers(wide)
    one = cumulative(df.withColumn("one", F.lit(1)), ["x", "row_id"], "one", "i")
    got = one.agg(F.count_distinct("i").alias("n"), F.min("i").alias("a"), F.max("i").alias("b"), F.sum(F.col("i") * F.pmod("row_id", F.lit(97))).alias("s")).first()
    order = pdf.sort_values(["x", "row_id"]).reset_index(drop=True)
    assert (got.n, got.a, got.b, got.s) == (N, 1, N, int(((order.index + 1) * (order.row_id % 97)).sum()))
    by = cumulative(df.withColumn("one", F.lit(1)), ["x", "row_id"], "one", "i", ["g"]).groupBy("g").agg(F.count_distinct("i").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert sorted((r.g, r.n, r.a, r.b) for r in by) == [(g, N // 3, 1, N // 3) for g in range(3)]


def test_xi_of_many_rows(wide):
    df, pdf = numbers(wide)
    p = pdf.sort_values(["x", "row_id"])
    r, low = p.y.rank(method="max").to_numpy(), p.y.rank(method="max", ascending=False).to_numpy()
    want = 1 - N * np.abs(np.diff(r)).sum() / (2 * (low * (N - low)).sum())
    assert association.xi(df, "x", "y").first().xi == pytest.approx(want, abs=1e-9)


def test_xi_where_products_pass_the_range_of_longs(spark):
    """4,000,000 rows: n times the summed differences of ranks, about n**3 / 3, is above 2**63."""
    n = 4_000_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("y"))
    same = association.xi(df.withColumn("y", F.col("x")), "x", "y").first()
    assert same.n == n and same.xi > 0.99
    assert abs(association.xi(df, "x", "y").first().xi) < 0.01


def test_counts_whose_products_pass_the_range_of_longs(spark):
    """Tables are counted, so a large one is planted by counts: the statistic of n times a table is n times its own."""
    small = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", "y"), ("b", "y"), ("b", "y")], "r string, c string")
    times = 400_000
    many = small.crossJoin(spark.range(times)).select("r", "c")
    assert inference.chi_square_by(many, ["r"], "c").first().statistic == pytest.approx(times * inference.chi_square_by(small, ["r"], "c").first().statistic)
    assert association.cramers_v(many, ["r"], "c").first().v == pytest.approx(association.cramers_v(small, ["r"], "c").first().v)
    assert sorted(r.expected / times for r in association.residuals(many, "r", "c").collect()) == pytest.approx(sorted(r.expected for r in association.residuals(small, "r", "c").collect()))


def test_ranks_and_quantiles_of_many_rows(spark):
    df, pdf = numbers(spark)
    got = avg_rank(df, "x").agg(F.sum("rank").alias("a"), F.sum(F.col("rank") * F.pmod("row_id", F.lit(89))).alias("b")).first()
    rank = pdf.x.rank()
    assert got.a == pytest.approx(rank.sum()) and got.b == pytest.approx((rank * (pdf.row_id % 89)).sum())
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    assert list(quantiles(df, [], "y", probs).first()) == pytest.approx(list(pdf.y.quantile(list(probs.values()))))
    for r in quantiles(df, ["g"], "x", probs).collect():
        assert [r[n] for n in probs] == pytest.approx(list(pdf[pdf.g == r.g].x.quantile(list(probs.values()))))


def test_quantiles_of_odd_tables(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 5.0)], "g string, v double")
    assert {r.g: r.m for r in quantiles(d, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "b": 5.0}
    assert quantiles(d.limit(0), [], "v", {"m": 0.5}).first().m is None and quantiles(d.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def brute_neighbours(keys, x, ref_keys, ref, k):
    out = {}
    for i, key in enumerate(keys):
        d = ((ref - x[i]) ** 2).sum(1)
        best = sorted((d[j], int(ref_keys[j])) for j in range(len(ref)) if ref_keys[j] != key)[:k]
        out[int(key)] = [(b, round(float(np.sqrt(a)), 9)) for a, b in best]
    return out


@pytest.mark.parametrize("cell, block", [(4096, 16384), (24, 20)])
def test_neighbours_match_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 3)), rng.integers(0, 3, (200, 3)), np.repeat([[0.5, 0.5, 0.5]], 60, 0), [[50.0, 0, 0], [-0.0, 0, 0], [1e6, 1e6, 1e6]]])
    keys = rng.permutation(len(x)) + 1
    d = spark.createDataFrame([(int(a), *map(float, v)) for a, v in zip(keys, x, strict=True)] + [(9999, None, 0.0, 0.0)], "row_id long, a double, b double, c double")
    got = {}
    for r in neighbours.knn_join(d, d, ["a", "b", "c"], 4).orderBy("row_id", "rank").collect():
        got.setdefault(r.row_id, []).append((r.neighbour, round(r.distance, 9)))
    assert got == brute_neighbours(keys, x, keys, x, 4)


def test_neighbours_meet_over_many_partitions(spark, monkeypatch):
    """Cells and blocks lie in partitions of their own, not in one that adaptive execution leaves of a small table."""
    monkeypatch.setattr(neighbours, "CELL", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    x, keys = np.random.default_rng(5).normal(size=(400, 2)), np.arange(400)
    d = spark.createDataFrame([(int(a), *map(float, v)) for a, v in zip(keys, x, strict=True)], "row_id long, a double, b double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in neighbours.knn_join(d, d, ["a", "b"], 3).orderBy("row_id", "rank").collect():
            got.setdefault(r.row_id, []).append((r.neighbour, round(r.distance, 9)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_neighbours(keys, x, keys, x, 3)


def test_neighbours_in_another_table_and_of_few_rows(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 5.0)], "row_id int, a double")
    ref = spark.createDataFrame([(10, 1.0), (11, 4.0), (12, 6.0), (13, None)], "row_id int, a double")
    got = [tuple(r) for r in neighbours.knn_join(d, ref, ["a"], 2).orderBy("row_id", "rank").collect()]
    assert got == [(1, 10, 1.0, 1), (1, 11, 4.0, 2), (2, 11, 1.0, 1), (2, 12, 1.0, 2), (3, 11, 1.0, 1), (3, 12, 1.0, 2)]
    assert neighbours.knn_join(d.where("row_id = 1"), d.where("row_id = 1"), ["a"], 2).count() == 0
    assert neighbours.knn_join(d, ref.limit(0), ["a"], 2).count() == 0 and neighbours.knn_join(d.limit(0), ref, ["a"], 2).count() == 0


def test_matching_takes_one_of_the_nearest_of_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=500)
    y = np.where(np.arange(500) % 5 == 0, np.nan, 2 * x + rng.normal(scale=0.1, size=500))
    d = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(500), "x": x, "y": y}).astype(object).where(lambda t: t.notna(), None).values.tolist(), "row_id long, x double, y double")
    got = {r.row_id: r.y for r in impute.impute_pmm(d, ["x", "y"], sweeps=1).collect()}
    seen = ~np.isnan(y)
    b, a = np.polyfit(x[seen], y[seen], 1)
    pred = a + b * x
    for i in range(500):
        if seen[i]:
            assert got[i] == y[i]
        else:
            near = np.argsort(np.abs(pred[seen] - pred[i]), kind="stable")[:5]
            assert min(abs(y[seen][near] - got[i])) < 1e-12
    three = impute.impute_multiple(d, ["x", "y"], 3, sweeps=1)
    assert three.count() == 1500 and three.where("y is null").count() == 0 and three.groupBy("row_id").agg(F.count_distinct("y").alias("n")).agg(F.max("n")).first()[0] > 1
    mean = {r.row_id: r.y for r in impute.impute_pmm(d, ["x", "y"], m=40, sweeps=1, average=True).collect()}
    i = 5
    near = np.argsort(np.abs(pred[seen] - pred[i]), kind="stable")[:5]
    assert y[seen][near].min() <= mean[i] <= y[seen][near].max()


def test_robust_distance_survives_a_second_group(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(900, 2)) @ [[1, 0.8], [0, 0.6]], rng.normal(loc=[6, -6], scale=0.2, size=(150, 2))])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    flagged = {r.row_id for r in outliers.outlier_robust(d, ["a", "b"]).collect()}
    assert set(range(900, 1050)) <= flagged and len(flagged) < 150 + 40
    assert outliers.outlier_robust(d.limit(0), ["a", "b"]).count() == 0


def test_scratch_removes_what_was_staged(spark):
    with stages.scratch(spark):
        path = stages.stage_path(spark, "x")
        spark.range(3).write.parquet(path)
        kept = stages.staged(spark.range(4), "y").count()
    assert kept == 4 and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(RuntimeError, match="share"):
        stages.stage_path(Fake, "x")


@pytest.mark.parametrize(("bins", "few"), [(4096, 1000), (3, 2), (64, 0)])
def test_nth_is_exact_in_skewed_and_repeated_values(spark, bins, few):
    rng = np.random.default_rng(4)
    cols = [rng.normal(size=300) ** 2, np.repeat([2.0, 5.0, 7.0], 100), 10.0 ** rng.uniform(-12, 12, 300)]
    d = spark.createDataFrame([tuple(float(c[i]) for c in cols) for i in range(300)] + [(None, None, None)], "a double, b double, c double")
    for rank in (1, 150, 225, 300):
        got = order.nth(d, [F.col("a"), F.col("b"), F.col("c")], [rank] * 3, bins, few)
        assert got == [float(np.sort(c)[rank - 1]) for c in cols]
    with pytest.raises(ValueError):
        order.nth(d, [F.col("a")], [301])


def test_robust_distance_equals_plain_concentration(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.multivariate_normal([0, 0], [[2, 1], [1, 3]], 260), rng.normal([9, -8], 0.5, (40, 2))])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    flagged = {r.row_id for r in outliers.outlier_robust(d, ["a", "b"], rounds=30).collect()}

    # from the centre that the planted group cannot move, nearest 225 rows again and again
    mean, cov = np.median(x, 0), np.diag((1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)) ** 2)
    dist = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    for _ in range(60):
        near = np.argsort(dist(mean, cov), kind="stable")[:225]
        mean, cov = x[near].mean(0), np.cov(x[near], rowvar=False)
    factor = 0.75 / (1 - stats.chi2_sf(stats.chi2_quantile(0.75, 2), 4))
    assert flagged == {int(i) for i in np.flatnonzero(dist(mean, cov * factor) > stats.chi2_quantile(0.99, 2))} and flagged >= set(range(260, 300))
