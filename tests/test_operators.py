"""Operators on small tables: hand-computed values, slow versions and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.functions import clean, features
from tarmac.operators import association, cluster, factor, impute, inference, joins, neighbours, outliers, profile, sampling, series, spatial, summary
from tarmac.sources import tables
from tarmac.sources.incidents import incidents


@pytest.fixture(scope="module")
def df(spark, sf):
    return incidents(spark, sf).cache()


NUM = ["humidity", "pressure_in", "temperature_f", "wind_speed_mph"]


def test_read_incidents(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Temperature(F),Amenity,Start_Time\nA-1, 50 ,True,2020-01-01 00:00:00\nA-2,NA,no,x\nA-3,,,\n")
    got = tables.read_incidents(spark, str(tmp_path), "id string, temperature_f double, amenity boolean, start_time timestamp, missing int").orderBy("id").collect()
    assert [r.temperature_f for r in got] == [50.0, None, None]
    assert [r.amenity for r in got] == [True, False, None]
    assert got[0].start_time.year == 2020 and got[1].start_time is None and got[0].missing is None


def test_stages(spark, df, tmp_path):
    tables.write_stage(df.select("row_id", "state"), str(tmp_path / "s"), ["state"])
    assert tables.read_stage(spark, str(tmp_path / "s")).count() == df.count()
    tables.write_profiles(spark.createDataFrame([(3, "a", 1.0)], "k int, variable string, v double"), str(tmp_path / "p"))
    assert (tmp_path / "p" / "k=3" / "variable=a").exists()


def test_samples(spark):
    d = spark.createDataFrame([(i, "a" if i < 100 else "b") for i in range(120)], "row_id long, g string")
    count = lambda x: {r.g: r["count"] for r in x.groupBy("g").count().collect()}
    assert count(sampling.sample_proportional(d, "g", 60, "row_id")) == {"a": 50, "b": 10}
    assert count(sampling.sample_frac_per_group(d, "g", 0.35, 10, "row_id")) == {"a": 35, "b": 10}
    assert count(sampling.sample_per_group(d, "g", 30, "row_id")) == {"a": 30, "b": 20}
    one, two = (sorted(r.row_id for r in sampling.sample_n(d, 7, "row_id").collect()) for _ in range(2))
    assert one == two and len(one) == 7


def test_hampel(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate((1, 2, 3, 4, 100))], "row_id long, x double")
    assert [r.row_id for r in outliers.outlier_hampel(d, ["x"]).collect()] == [4]


def test_chi_square_and_residuals(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    d = spark.createDataFrame(rows, "r string, c string")
    got = association.chi_square(d, "r", "c").first()
    assert got.statistic == pytest.approx(0.793651, abs=1e-6) and got.dof == 1 and got.p_value == pytest.approx(0.373, abs=1e-3)
    assert association.cramers_v(d, ["r"], "c").first().v == pytest.approx(0.089087, abs=1e-6)
    res = {(x.row_cat, x.col_cat): x.residual for x in association.residuals(d, "r", "c").collect()}
    assert res["a", "x"] == pytest.approx(-0.890871, abs=1e-6)
    small = spark.createDataFrame([("a", "x")] * 4 + [("b", "y")] * 4, "r string, c string")
    assert association.chi_square(small, "r", "c", simulate=200).first().p_value == pytest.approx(2 / 70, abs=0.03)


def test_vtest(spark):
    d = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 5.0), ("B", 8.0)], "g string, x double")
    got = {r.cluster: r.v_test for r in profile.vtest_numeric(d, ["x"], "g").collect()}
    assert got["A"] == pytest.approx(-1.581139, abs=1e-6) and got["B"] == pytest.approx(1.581139, abs=1e-6)


def test_balance_and_ranks(spark):
    d = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "c int")
    b = summary.cluster_balance(d, "c").first()
    assert b.min_prop == pytest.approx(0.2) and b.imbalance == pytest.approx(4)
    r = summary.rank_total(spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1.0)], "k int, m double"), [], ["m"])
    assert [x.rank_m for x in r.orderBy("k").collect()] == [3, 1, 1]


def test_lof_against_slow_version(spark):
    x = np.random.default_rng(3).normal(size=(60, 2))
    x[0] = [9, 9]
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    got = {r.row_id: r.lof for r in outliers.lof_scores(d, ["a", "b"], k=5, scale=False).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, 1)[:, :5]
    kd = np.sort(dist, 1)[:, 4]
    lrd = np.array([1 / np.mean([max(dist[i, j], kd[j]) for j in near[i]]) for i in range(60)])
    slow = [np.mean(lrd[near[i]]) / lrd[i] for i in range(60)]
    assert np.allclose([got[i] for i in range(60)], slow)
    assert {r.row_id for r in outliers.outlier_lof(d, ["a", "b"], scale=False).collect()} == {i for i in range(60) if slow[i] > 2} >= {0}


def test_detectors_find_planted_rows(spark):
    x = np.random.default_rng(4).normal(size=(400, 3))
    x[:5] += 12
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    cols, planted = ["a", "b", "c"], set(range(5))
    ids = lambda f: {r.row_id for r in f.collect()}
    assert planted <= ids(outliers.outlier_mahalanobis(d, cols)) and planted <= ids(outliers.outlier_robust(d, cols))
    assert planted <= ids(outliers.outlier_iforest(d, cols, trees=50)) and planted <= ids(outliers.outlier_knn(d, cols, k=6, top_n=20))
    assert len(ids(outliers.outlier_robust(d, cols))) < 40


def test_forest_by_level_against_a_plain_version(spark):
    """The same draws and cuts, one row and tree after the other; equal rows, a constant column, and nulls."""
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 4)), 5.0) for i in range(60)] + [(60 + i, 0.5, 1.0, 5.0) for i in range(6)] + [(70, 40.0, 3.0, 5.0), (71, None, 1.0, 5.0)]
    d = spark.createDataFrame(rows, "row_id long, a double, b double, c double").withColumns({"tree": F.lit("x"), "node": F.lit(1)})
    got = {r.row_id: r.depth for r in outliers.iforest_depths_by_level(d, ["a", "b", "c"], trees=5, at_once=2, seed=9).collect()}
    seed, most = 9, int(np.ceil(np.log2(0.5 * 67)))
    uniform = lambda *salt: (F.xxhash64(*salt, F.lit(seed)) / float(2**63) + 1) / 2
    grid = spark.range(5).select(F.col("id").cast("int").alias("tree")).join(spark.range(1, 2 << most).select(F.col("id").alias("node")))
    cuts = {(r.tree, r.node): (r.c, r.u) for r in grid.select("tree", "node", uniform("tree", "node", F.lit("column")).alias("c"), uniform("tree", "node", F.lit("cut")).alias("u")).collect()}
    draws = spark.range(72).join(spark.range(5).select(F.col("id").cast("int").alias("tree"))).select("id", "tree", uniform("id", "tree", F.lit("draw")).alias("u")).collect()
    times = {(r.id, r.tree): sum(r.u >= sum(np.exp(-0.5) * 0.5**k / math.factorial(k) for k in range(m + 1)) for m in range(12)) for r in draws}
    want = dict.fromkeys(range(71), 0.0)

    def grow(tree, node, inside, depth):
        drawn = [(i, x) for i, x in inside if times[i, tree]]
        n = sum(times[i, tree] for i, _ in drawn)
        wide = [j for j in range(3) if drawn and max(x[j] for _, x in drawn) > min(x[j] for _, x in drawn)]
        if n < 2 or depth == most or not wide:
            for i, _ in inside:
                want[i] += depth + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n >= 2 else 0)
            return
        c, u = cuts[tree, node]
        j = wide[int(c * len(wide))]
        lo, hi = min(x[j] for _, x in drawn), max(x[j] for _, x in drawn)
        cut = lo + u * (hi - lo)
        for side in (0, 1):
            grow(tree, 2 * node + side, [(i, x) for i, x in inside if (x[j] >= cut) == bool(side)], depth + 1)

    for tree in range(5):
        grow(tree, 1, [(r[0], r[1:]) for r in rows if r[1] is not None], 0)
    assert set(got) == {r[0] for r in rows if r[1] is not None}
    assert all(got[i] == pytest.approx(want[i] / 5) for i in got)
    flagged = {r.row_id for r in outliers.outlier_iforest(d, ["a", "b", "c"], trees=20, share=0.5).collect()}
    assert 70 in flagged
    assert outliers.outlier_iforest(d.limit(0), ["a"], trees=2, share=0.5).count() == 0


def test_imputation_keeps_what_was_observed(df):
    base = df.select("row_id", "state", *NUM, "sunrise_sunset")
    before = {r.row_id: r for r in base.collect()}
    for out in (impute.impute_pmm(base, NUM, sweeps=1), impute.impute_chained(base, NUM, sweeps=1), impute.impute_random(base, "humidity"), impute.impute_knn(base, "humidity", ["pressure_in"], ["state"]), impute.impute_by_cluster(base, ["pressure_in", "wind_speed_mph"], ["humidity"], sample=100)):
        rows = out.collect()
        assert len(rows) == len(before)
        for r in rows:
            assert r.humidity is not None
            if before[r.row_id].humidity is not None:
                assert r.humidity == before[r.row_id].humidity


def test_pmm_draws_observed_values(df):
    seen = {r.humidity for r in df.select("humidity").dropna().collect()}
    assert {r.humidity for r in impute.impute_pmm(df.select("row_id", *NUM), NUM, sweeps=1).collect()} <= seen


def test_famd_eigenvalues_sum(df):
    base = impute.impute_simple(df, {"humidity": "median", "sunrise_sunset": "mode"}).withColumn("flag", F.col("junction").cast("string"))
    axes = factor.famd(base, ["humidity", "pressure_in"], ["sunrise_sunset", "flag"], 4)
    assert axes.values.sum() == pytest.approx(2 + (2 - 1) + (2 - 1), abs=1e-6)
    coords = axes.project(base, 2, ["row_id"])
    got = coords.agg(F.avg("dim_1"), F.var_pop("dim_1"), F.corr("dim_1", "dim_2")).first()
    assert abs(got[0]) < 1e-6 and got[1] == pytest.approx(axes.values[0], rel=1e-6) and abs(got[2]) < 1e-6


def test_ca_matches_chi_square(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    inertia = factor.ca(part, "p_type", "p_brand")[0].agg(F.sum("eigenvalue")).first()[0]
    got = association.chi_square(part, "p_type", "p_brand").first()
    assert inertia == pytest.approx(got.statistic / got.n, rel=1e-9)


def test_sparse_ca_equals_the_dense_one(spark):
    """Axes, contributions and cos2 of the table as it is, and of documents with more terms than are held at once."""
    rng = np.random.default_rng(3)
    counts = rng.poisson(np.exp(rng.normal(0, 1, (14, 2)) @ rng.normal(0, 1, (2, 9))))
    df = spark.createDataFrame([(f"r{i}", f"c{j}") for i, j in np.ndindex(counts.shape) for _ in range(counts[i, j])] + [(None, "c1"), ("r1", None)], "a string, b string")
    eig, found = factor.ca(df, "a", "b")
    some, mine = factor.ca(df, "a", "b", ncp=2)
    assert [r.eigenvalue for r in some.orderBy("axis").collect()] == pytest.approx([r.eigenvalue for r in eig.where("axis <= 2").orderBy("axis").collect()], rel=1e-8)
    assert [r.percent for r in some.orderBy("axis").collect()] == pytest.approx([r.percent for r in eig.where("axis <= 2").orderBy("axis").collect()], rel=1e-6)
    want = {(r.side, r.category, r.axis): r for r in found.where("axis <= 2").collect()}
    got = {(r.side, r.category, r.axis): r for r in mine.collect()}
    assert got.keys() == want.keys()
    for axis in (1, 2):
        sign = 1 if np.dot([got[k].coord for k in want if k[2] == axis], [want[k].coord for k in want if k[2] == axis]) > 0 else -1
        for k in (k for k in want if k[2] == axis):
            assert (got[k].coord * sign, got[k].contribution, got[k].cos2) == pytest.approx((want[k].coord, want[k].contribution, want[k].cos2), abs=1e-6)
    dtm = spark.createDataFrame([(i, f"t{j}", int(counts[i, j])) for i, j in np.ndindex(counts.shape) if counts[i, j]], "doc_id long, term string, tf long")
    dense, sparse = factor.ca_text(dtm), factor.ca_text(dtm, most_terms=3)
    a, b = ({r.doc_id: r.dim_1 for r in x[2].collect()} for x in (dense, sparse))
    assert np.abs(np.corrcoef([a[i] for i in a], [b[i] for i in a])[0, 1]) == pytest.approx(1, abs=1e-9)
    assert factor.ca_sparse(dtm.select(F.col("doc_id").alias("row"), F.col("term").alias("col"), F.col("tf").alias("n")).limit(0), 2)[1].count() == 0


def test_ca_text_matches_ca(spark):
    rows = [(d, t, n) for d, t, n in ((1, "a", 3), (1, "b", 1), (2, "a", 1), (2, "c", 4), (3, "b", 2), (3, "c", 1))]
    dtm = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    eig = [r.eigenvalue for r in factor.ca_text(dtm)[0].orderBy("axis").collect()]
    flat = spark.createDataFrame([(str(d), t) for d, t, n in rows for _ in range(n)], "r string, c string")
    assert eig[:2] == pytest.approx([r.eigenvalue for r in factor.ca(flat, "r", "c")[0].orderBy("axis").collect()], abs=1e-9)


def test_clusters_cover_all_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, size=(80, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    d = spark.createDataFrame([(i, "s" + str(i % 3), float(a), float(b), "u" if i < 80 else "v") for i, (a, b) in enumerate(x)], "row_id long, state string, a double, b double, c string")
    out, centres = cluster.hier_kmeans(d, ["a", "b"], "state", sample=90, k=3)
    sizes = sorted(r["count"] for r in out.groupBy("cluster").count().collect())
    assert sizes == [80, 80, 80] and len(centres) == 3
    assert cluster.silhouette(out, ["a", "b"], "cluster") > 0.9
    k, _ = cluster.kprototypes(d, ["a", "b"], ["c"], 2, n_init=2)
    assert k.count() == 240
    cure = cluster.cure_mixed(d, ["a", "b"], ["c"], "state", 3)
    assert sorted(r["count"] for r in cure.groupBy("cluster").count().collect()) == [80, 80, 80]
    small = cluster.reassign_small(out.withColumn("cluster", F.when(F.col("row_id") == 0, 9).otherwise(F.col("cluster"))), ["a", "b"], 10)
    assert sorted(r["count"] for r in small.groupBy("cluster").count().collect()) == [80, 80, 80]


def test_selection(spark):
    m = spark.createDataFrame([("m", 2, 0.60, 0.20, 4.0), ("m", 3, 0.605, 0.10, 5.0), ("m", 4, 0.9, 0.01, 50.0)], "method string, k int, silhouette double, min_prop double, imbalance double")
    assert cluster.select_clustering(m).first().k == 2
    assert summary.best_model(m.withColumn("valid", F.lit(False))).first().k == 4


def test_series(spark):
    long = spark.createDataFrame([(k, f"2020-{m:02d}", float((m * (k + 1)) % 5)) for k in range(6) for m in range(1, 9)], "key int, period string, v double")
    pairs = series.dtw_pairs(long, "key", "period", "v")
    assert pairs.count() == 15
    for lab in (series.series_pam(pairs, 3), series.series_hclust(pairs, [3])):
        assert lab.select("key").distinct().count() == 6 and lab.select("cluster").distinct().count() == 3


def test_anova_and_kruskal_on_three_groups(spark):
    d = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (2.0, 3.0, 4.0)] + [("c", v) for v in (5.0, 6.0, 7.0)], "g string, x double")
    a = inference.anova(d, ["x"], "g").first()
    assert a.f == pytest.approx(13.0) and a.p_value_descriptive == pytest.approx(0.0066, abs=1e-3)
    assert inference.kruskal(d, ["x"], "g").first().h == pytest.approx(6.0565, abs=1e-4)
    assert inference.pairwise_means(d, "x", "g").count() == 3 and inference.pairwise_wilcoxon(d, "x", "g").count() == 3


def test_average_ranks(spark):
    d = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, None)], "x double")
    assert sorted((r.x, r["rank"]) for r in summary.avg_rank(d, "x").where("x is not null").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_utm_against_a_known_point(spark):
    x, y = spatial.utm(F.lit(40.7128), F.lit(-74.0060))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(583.96, abs=0.01) and r.y == pytest.approx(4507.35, abs=0.01)


def test_density_integrates_to_the_number_of_points(spark):
    d = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(50)], "x double, y double")
    total = spatial.kde(d, "x", "y", 2.0, 0.5, reach=5.0).agg(F.sum("density")).first()[0] * 0.25
    assert total == pytest.approx(50, rel=0.01)


def test_empty_tables(spark, df):
    none = df.limit(0)
    assert summary.frequencies(none, ["state"]).count() == 0 and summary.kpis(none).first().rows == 0
    assert outliers.outlier_iqr(none, NUM).count() == 0 and sampling.sample_proportional(none, "state", 10, "row_id").count() == 0
    assert joins.remove_rows(none, none, ["row_id"]).count() == 0 and features.collapse_rare(none, "state").count() == 0
    assert clean.complete_cases(none, NUM).count() == 0 and neighbours.standardised(none, NUM, "row_id").count() == 0


@pytest.mark.parametrize("few, copies", [(20_000, 1), (5, 1), (5, 40)])
def test_concentration_steps_are_exact(spark, few, copies):
    """The h nearest rows with ties, whatever the sample says of the bounds, narrowed bin by bin or not."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(0, 1, (1200 // copies, 3)) * [1, 50, 0.01], copies, axis=0)
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    fits = {0: (x.mean(0), np.cov(x, rowvar=False)), 2: (np.zeros(3), np.eye(3))}
    for small in (x[:100], x[:100] * 30):
        got = outliers._concentrated(d, ["a", "b", "c"], fits, 900, small, 0.75, bins=16, few=few)
        for i, (mean, cov) in fits.items():
            v = outliers._distances(x, mean, np.linalg.pinv(cov))
            near = x[v <= np.sort(v)[899]]
            assert np.allclose(got[i][0], near.mean(0), rtol=1e-9, atol=1e-12) and np.allclose(got[i][1], np.cov(near, rowvar=False), rtol=1e-9, atol=1e-12)
