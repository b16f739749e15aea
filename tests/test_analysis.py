"""Registered queries without SQL: against numpy and pandas on the smallest tables, or planted cases."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.functions import stats, text
from tarmac.operators import association, cluster, factor, inference, series, spatial, topics
from tarmac.plans import analysis
from tarmac.plans.registry import QUERIES
from tarmac.sources.incidents import incidents

NUM, FNUM, FCAT = analysis.NUM, analysis.FNUM, analysis.FCAT


@pytest.fixture(scope="module")
def rows(spark, sf):
    return incidents(spark, sf).toPandas()


@pytest.fixture(scope="module")
def base(spark, sf):
    return analysis.base_rows(spark, sf).toPandas().sort_values("row_id").reset_index(drop=True)


def run(spark, sf, name):
    return QUERIES[name](spark, sf).toPandas()


# factors


def indicators(base, cat):
    return pd.concat([(base[c] == level).astype(float).rename((c, level)) for c in cat for level in sorted(base[c].unique())], axis=1)


def axes_of(x, scale):
    """Eigenvalues and vectors of the covariance of scaled columns, largest first."""
    cov = np.cov((x / scale).T, ddof=0)
    values, vectors = np.linalg.eigh(cov)
    return values[::-1], vectors[:, ::-1]


def same_axis(a, b, tol=1e-4):
    return np.allclose(a, b, atol=tol) or np.allclose(a, -b, atol=tol)


def test_principal_axes(spark, sf, base):
    x = base[FNUM].to_numpy(float)
    values, vectors = axes_of(x, x.std(0))
    got = run(spark, sf, "principal_axes").sort_values("row_id")
    want = (x - x.mean(0)) / x.std(0) @ vectors[:, :2]
    for k in (0, 1):
        assert same_axis(got[f"dim_{k + 1}"].to_numpy(), want[:, k]) and got[f"dim_{k + 1}"].var(ddof=0) == pytest.approx(values[k], rel=1e-4)


def test_mca_axes_contributions_and_retained_values(spark, sf, base):
    z = indicators(base, FCAT)
    values, vectors = axes_of(z.to_numpy(), np.sqrt(z.mean().to_numpy()))
    values = values / len(FCAT)
    got = run(spark, sf, "mca_axes")
    want = dict(zip(z.columns, vectors[:, 0] ** 2 * 100, strict=True))
    assert len(got) == min(20, len(want)) and list(got.contribution) == sorted(got.contribution, reverse=True)
    for r in got.itertuples():
        assert r.contribution == pytest.approx(want[r.variable, r.level], abs=1e-4) and r.axis == 1
        assert r.eigenvalue == pytest.approx(values[0], abs=1e-5) if values[0] > 1 / 3 else math.isnan(r.eigenvalue)
    axes = factor.mca(analysis.base_rows(spark, sf), FCAT, 2)
    coords = axes.project(analysis.base_rows(spark, sf), 2, ["row_id"]).toPandas().sort_values("row_id")
    for r in axes.variables(spark).collect():
        at = (base[r.variable] == r.level).to_numpy()
        assert r.coord == pytest.approx(coords[f"dim_{r.axis}"].to_numpy()[at].mean() / math.sqrt(values[r.axis - 1]), abs=1e-6)
    mixed = factor.famd(analysis.base_rows(spark, sf), FNUM, FCAT, 2)
    coords = mixed.project(analysis.base_rows(spark, sf), 2, ["row_id"]).toPandas().sort_values("row_id")
    for r in mixed.variables(spark).collect():
        y = coords[f"dim_{r.axis}"].to_numpy()
        assert r.coord == pytest.approx(np.corrcoef(base[r.variable], y)[0, 1] if r.level is None else y[(base[r.variable] == r.level).to_numpy()].mean(), abs=1e-6)
    eig = factor.eigen_table(spark, values)
    assert {r.axis for r in factor.retain(eig, 3).collect()} == {i + 1 for i, v in enumerate(values) if v > 1 / 3}


def mca_coordinates(base, k):
    z = indicators(base, FCAT)
    scale = np.sqrt(z.mean().to_numpy())
    values, vectors = axes_of(z.to_numpy(), scale)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return values[:k] / len(FCAT), ((z - z.mean()).to_numpy() / scale @ vectors[:, :k]) / math.sqrt(len(FCAT))


def test_mca_individuals_and_supplementary(spark, sf, base):
    values, x = mca_coordinates(base, 2)
    got = run(spark, sf, "mca_individuals").sort_values("row_id")
    assert np.allclose(got[["dim_1", "dim_2"]].to_numpy(), x, atol=1e-4)
    assert np.allclose(got.cos2_dim_1, x[:, 0] ** 2 / (x**2).sum(1), atol=1e-3)
    assert np.allclose(got.contrib_dim_2, x[:, 1] ** 2 * 100 / (len(x) * values[1]), rtol=1e-3, atol=1e-5) and got.contrib_dim_1.sum() == pytest.approx(100, abs=0.1)
    sup = run(spark, sf, "mca_supplementary")
    for r in sup.itertuples():
        at = (base.severity.astype(str) == r.level).to_numpy()
        assert r.n == at.sum() and (r.dim_1, r.dim_2) == pytest.approx(tuple(x[at].mean(0)), abs=1e-4)
    for r in run(spark, sf, "mca_supplementary_numbers").itertuples():
        assert r.r == pytest.approx(np.corrcoef(base[r.variable], x[:, int(r.axis[-1]) - 1])[0, 1], abs=1e-4)


def test_axis_description(spark, sf, base):
    coords = factor.famd(analysis.base_rows(spark, sf), FNUM, FCAT, 3).project(analysis.base_rows(spark, sf), 3, ["row_id"]).toPandas().sort_values("row_id")
    got = {(r.axis, r.variable): (r.kind, r.value) for r in run(spark, sf, "axis_description").itertuples()}
    n, found = len(base), {}
    for axis in ("dim_1", "dim_2", "dim_3"):
        y = coords[axis].to_numpy()
        for c in FNUM:
            r = np.corrcoef(base[c], y)[0, 1]
            if stats.t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) <= 0.05:
                found[axis, c] = ("correlation", r)
        g = [y[(base.severity == s).to_numpy()] for s in sorted(base.severity.unique())]
        between = sum(len(v) * (v.mean() - y.mean()) ** 2 for v in g)
        r2 = between / ((y - y.mean()) ** 2).sum()
        if stats.f_sf(r2 / (len(g) - 1) / ((1 - r2) / (n - len(g))), len(g) - 1, n - len(g)) <= 0.05:
            found[axis, "severity"] = ("r2", r2)
    assert set(got) == set(found) and all(got[k][0] == found[k][0] and got[k][1] == pytest.approx(found[k][1], abs=1e-3) for k in found)


def test_top_individuals(spark, sf, base):
    coords = factor.famd(analysis.base_rows(spark, sf), FNUM, FCAT, 2).project(analysis.base_rows(spark, sf), 2, ["row_id"]).toPandas()
    coords["score"] = coords.dim_1**2 + coords.dim_2**2
    want = coords.sort_values(["score", "row_id"], ascending=[False, True]).head(30)
    got = run(spark, sf, "top_individuals")
    assert set(got.row_id) == set(want.row_id) and got.score.sum() == pytest.approx(want.score.sum(), rel=1e-5)
    states = base.set_index("row_id").state
    assert all(states[r.row_id] == r.state for r in got.itertuples() if r.state is not None)


def test_number_of_axes(spark):
    eig = lambda *v: factor.eigen_table(spark, np.array(v, float))
    assert factor.choose_dims(eig(*[1] * 20)) == 8 and factor.choose_dims(eig(*[10, 1, 1, 1, 1, 1])) == 5
    assert factor.choose_dims(eig(*[1] * 60)) == 12 and factor.choose_dims(eig(5, 1)) == 2


# associations and tests


def test_redundant_columns(spark, sf, rows):
    d = rows[NUM].astype(float).copy()
    d["temperature_c"] = (d.temperature_f - 32) * 5 / 9
    corr = d.corr().abs()
    mean = {c: round(corr[c].drop(c).mean(), 9) for c in d}
    gone = []
    for a, b in sorted(itertools.combinations(sorted(d), 2), key=lambda p: (-round(corr.loc[p], 9), p)):
        if corr.loc[a, b] > 0.85 and a not in gone and b not in gone:
            gone.append(max((a, b), key=lambda c: (mean[c], c)))
    assert gone and sorted(run(spark, sf, "redundant_columns").variable) == sorted(gone)


def kruskal_h(groups):
    v = pd.Series(np.concatenate(groups)).rank().to_numpy()
    n, at, s = len(v), 0, 0.0
    for g in groups:
        s += v[at : at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    ties = sum(t**3 - t for t in Counter(np.concatenate(groups).tolist()).values())
    return (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n**3 - n))


def test_significance_of_variables(spark, sf, rows):
    got = {r.variable: r for r in run(spark, sf, "significance_of_variables").itertuples()}
    assert set(got) == {*NUM, "weather_condition", "sunrise_sunset"}
    for c in NUM:
        d = rows[[c, "severity"]].dropna().astype(float)
        groups = [g[c].to_numpy() for _, g in d.groupby("severity")]
        normal = True
        for g in groups:
            z = (g - g.mean()) / g.std()
            normal &= stats.chi2_sf(len(g) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4), 2) > 0.05
        k, n = len(groups), len(d)
        between = sum(len(g) * (g.mean() - d[c].mean()) ** 2 for g in groups) / (k - 1)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - k)
        want = ("anova", between / within, stats.f_sf(between / within, k - 1, n - k)) if normal else ("kruskal", (h := kruskal_h(groups)), stats.chi2_sf(h, k - 1))
        assert got[c].test == want[0] and (got[c].statistic, got[c].p_value_descriptive) == pytest.approx(want[1:], abs=2e-3)
    for c in ("weather_condition", "sunrise_sunset"):
        t = pd.crosstab(rows[c], rows.severity).to_numpy(float)
        e = np.outer(t.sum(1), t.sum(0)) / t.sum()
        chi = ((t - e) ** 2 / e).sum()
        p = stats.chi2_sf(chi, (t.shape[0] - 1) * (t.shape[1] - 1))
        assert (got[c].statistic, got[c].p_value_descriptive) == pytest.approx((chi, p), abs=1e-3) and got[c].significant == (p < 0.05)


def test_pairwise_tests(spark, sf, rows):
    d = rows[["humidity", "severity"]].dropna().astype(float)
    g = {s: v.humidity.to_numpy() for s, v in d.groupby("severity")}
    pairs = list(itertools.combinations(sorted(g), 2))
    dof = len(d) - len(g)
    pooled = sum(((v - v.mean()) ** 2).sum() for v in g.values()) / dof
    means = {(r.a, r.b): r for r in run(spark, sf, "pairwise_mean_tests").itertuples()}
    ranks = {(r.a, r.b): r for r in run(spark, sf, "pairwise_rank_tests").itertuples()}
    assert set(means) == set(ranks) == set(pairs)
    for a, b in pairs:
        x, y = g[a], g[b]
        t = (y.mean() - x.mean()) / math.sqrt(pooled * (1 / len(x) + 1 / len(y)))
        assert (means[a, b].diff, means[a, b].t, means[a, b].dof) == pytest.approx((y.mean() - x.mean(), t, dof), abs=1e-3)
        assert means[a, b].p_value_descriptive == pytest.approx(min(1, stats.t_sf2(t, dof) * len(pairs)), abs=1e-3)
        both = pd.Series(np.concatenate((x, y)))
        n1, n2 = len(x), len(y)
        u = both.rank()[:n1].sum() - n1 * (n1 + 1) / 2
        n = n1 + n2
        sd = math.sqrt(n1 * n2 / 12 * (n + 1 - sum(c**3 - c for c in both.value_counts()) / (n * (n - 1))))
        z = (u - n1 * n2 / 2) / sd
        assert (ranks[a, b].u, ranks[a, b].z) == pytest.approx((u, z), abs=1e-3) and ranks[a, b].p_value_descriptive == pytest.approx(min(1, stats.normal_sf2(z) * len(pairs)), abs=1e-3)


def test_kruskal_by_hand(spark):
    d = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (2.0, 3.0, 4.0)] + [("c", v) for v in (5.0, 6.0, 7.0)], "g string, x double")
    assert inference.kruskal(d, ["x"], "g").first().h == pytest.approx(6.05650, abs=1e-4)  # rank sums 8, 13, 24


def test_vtests_of_categories(spark, sf, rows):
    got = {(r.cluster, r.variable, r.level): r for r in run(spark, sf, "vtests_of_categories").itertuples()}
    for c in ("weather_condition", "sunrise_sunset", "state"):
        d = rows[[c, "severity"]].dropna(subset=[c])
        t = pd.crosstab(d[c], d.severity)
        for level, s in itertools.product(t.index, t.columns):
            n, nk, nj, total = t.loc[level, s], t[s].sum(), t.loc[level].sum(), t.to_numpy().sum()
            r = got[s, c, level]
            assert (r.n, r.level_in_cluster, r.cluster_in_level, r.overall) == pytest.approx((n, n / nk, n / nj, nj / total), abs=1e-3)
            assert r.v_test == pytest.approx(stats.hypergeometric_v(n, nk, nj, total), abs=1e-3)


def test_forest_importance(spark, sf):
    got = run(spark, sf, "forest_importance")
    assert set(got.variable) == {*NUM, "hour", "weather_condition", "sunrise_sunset"} and got.importance.sum() == pytest.approx(1, abs=1e-3)
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(float(a), float(b), "u" if a > 0.3 else "v", int(a > 0.3)) for a, b in rng.normal(size=(300, 2))], "a double, b double, c string, y int")
    assert association.rf_importance(d, ["b", "a"], "y", trees=10).first().variable == "a"
    assert association.rf_importance(d, ["b", "c"], "y", trees=10).first().variable == "c"


# imputation


def test_imputation_by_forest_and_averages(spark, sf, rows):
    seen = rows.set_index("row_id")
    for name, cols in (("imputed_by_forest", ["humidity"]), ("imputed_by_averaged_pmm", NUM), ("imputed_several_times", ["humidity"])):
        got = run(spark, sf, name)
        assert len(got) == len(rows) * (3 if name == "imputed_several_times" else 1)
        for c in cols:
            before = seen[c].reindex(got.row_id).astype(float).to_numpy()
            known = ~np.isnan(before)
            assert np.allclose(got[c].to_numpy(float)[known], before[known], atol=1e-6)
            new = got[c].to_numpy(float)[~known]
            if not len(new):
                continue
            assert not np.isnan(new).any() and new.min() >= np.nanmin(before) and new.max() <= np.nanmax(before)


# clusters


def test_kmeans_labels_and_criteria(spark, sf):
    coords, dims = analysis._coords(spark, sf)
    x = coords.toPandas().set_index("row_id")[dims]
    got = run(spark, sf, "kmeans_labels").set_index("row_id")
    for k in (3, 4):
        lab = got[f"k{k}"].reindex(x.index).to_numpy()
        centres = np.stack([x.to_numpy()[lab == g].mean(0) for g in range(k)])
        d = ((x.to_numpy()[:, None] - centres[None]) ** 2).sum(2)
        assert set(lab) == set(range(k)) and (d.argmin(1) == lab).mean() > 0.98  # a fixed point, but for rows on a border
    labels = cluster.kmeans_grid(coords, dims, [3], max_iter=10).toPandas().set_index("row_id").sort_index()
    m = cluster.cluster_criteria(spark.createDataFrame(labels.reset_index()), dims, [3], dunn_sample=len(labels)).first()
    v, lab = labels[dims].to_numpy(), labels.k3.to_numpy()
    within = sum(((v[lab == g] - v[lab == g].mean(0)) ** 2).sum() for g in range(3))
    between = sum((lab == g).sum() * ((v[lab == g].mean(0) - v.mean(0)) ** 2).sum() for g in range(3))
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    same = lab[:, None] == lab[None]
    assert (m.within, m.between, m.ratio) == pytest.approx((within, between, between / (within + between)), rel=1e-6)
    assert m.ch == pytest.approx(between / 2 / (within / (len(v) - 3)), rel=1e-6) and m.dunn == pytest.approx(d[~same].min() / d[same].max(), abs=1e-4)
    whole = run(spark, sf, "kmeans_criteria")
    assert sorted(whole.k) == [3, 4, 5] and (whole.rank_total == whole[[c for c in whole if c.startswith("rank_") and c != "rank_total"]].sum(axis=1)).all()


def test_more_starts_never_cost_more(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.2, size=(30, 2)) for c in itertools.product((0, 3, 6), (0, 3))])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")

    def cost(starts):
        lab = cluster.kmeans_grid(d, ["a", "b"], [6], starts=starts).toPandas().sort_values("row_id").k6.to_numpy()
        return sum(((x[lab == g] - x[lab == g].mean(0)) ** 2).sum() for g in set(lab))

    assert cost(8) <= cost(1) + 1e-9 and cost(8) == pytest.approx(sum(((x[i : i + 30] - x[i : i + 30].mean(0)) ** 2).sum() for i in range(0, 180, 30)), rel=1e-6)


def test_hierarchy_by_height(spark, sf):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, size=(n, 2)) for c, n in (((0, 0), 90), ((9, 9), 60), ((0, 6), 4))])
    d = spark.createDataFrame([(i, "s", float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, state string, a double, b double")
    out, centres = cluster.hier_kmeans(d, ["a", "b"], "state", sample=154, k=None, height=9.0)
    assert len(centres) == 3 and sorted(r["count"] for r in out.groupBy("cluster").count().collect()) == [4, 60, 90]
    small = {r.row_id: r.cluster for r in cluster.reassign_small(out, ["a", "b"], 20).collect()}
    assert Counter(small.values()) == Counter({1: 94, 2: 60})
    coords, dims = analysis._coords(spark, sf)
    got = run(spark, sf, "hierarchy_by_height")
    sizes = got.cluster.value_counts()
    assert len(got) == coords.count() and sorted(sizes.index) == list(range(1, len(sizes) + 1)) and list(sizes.sort_index()) == sorted(sizes, reverse=True)
    assert sizes.min() >= 200 or len(sizes) == 1


@pytest.mark.parametrize("kind", ["groups", "ring", "copies", "one"])
def test_dunn_over_all_rows(spark, monkeypatch, kind):
    """The nearest rows of different clusters and the farthest ones of a cluster are found among all rows, however few cells are broadcast."""
    monkeypatch.setattr(cluster, "FEW_CELLS", 2 if kind in ("ring", "copies") else 20_000)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 3)) * (1, 2, 0.3)
    if kind == "ring":
        turn = rng.uniform(0, 2 * np.pi, 1500)
        x = np.column_stack([np.cos(turn), np.sin(turn), 0 * turn]) * 5 + 1e6
    g = np.zeros(1500, int) if kind == "one" else (x[:, 0] > np.median(x[:, 0])).astype(int) + 2 * (x[:, 1] > np.median(x[:, 1]) + 1)
    if kind == "copies":
        x[7], g[7], g[11], x[11] = x[8], 4, 5, x[8]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same = g[:, None] == g[None]
    df = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(g, x, strict=True)], "k int, a double, b double, c double")
    least, widest = (d[~same].min() if (~same).any() else np.inf), d[same].max()
    assert cluster.diameter(df, ["a", "b", "c"], "k") == pytest.approx(widest, rel=1e-9)
    assert cluster.separation(df, ["a", "b", "c"], "k", sample=20) == pytest.approx(least, rel=1e-9)
    assert cluster.dunn(df, ["a", "b", "c"], "k") == pytest.approx(0 if kind == "one" else least / widest, rel=1e-9)


def test_kmeans_criteria_take_all_rows(spark, sf):
    coords, dims = analysis._coords(spark, sf)
    labels = cluster.kmeans_grid(coords, dims, [3, 4, 5], max_iter=10).toPandas()
    whole, d = run(spark, sf, "kmeans_criteria").set_index("k"), np.sqrt(((labels[dims].to_numpy()[:, None] - labels[dims].to_numpy()[None]) ** 2).sum(2))
    for k in (3, 4, 5):
        same = labels[f"k{k}"].to_numpy()[:, None] == labels[f"k{k}"].to_numpy()[None]
        assert whole.dunn[k] == pytest.approx(d[~same].min() / d[same].max(), abs=1e-4)


def test_hierarchy_by_height_goes_on_to_rest(spark, sf, monkeypatch):
    """The query's height cuts the tree into several clusters, and k-means over all rows ends at a fixed point."""
    seen, small = [], cluster.reassign_small
    monkeypatch.setattr(cluster, "reassign_small", lambda df, *a, **k: seen.append(df.toPandas()) or small(df, *a, **k))
    run(spark, sf, "hierarchy_by_height")
    x, lab = seen[0].filter(like="dim_").to_numpy(), seen[0].cluster.to_numpy()
    centres = np.stack([x[lab == g].mean(0) for g in range(lab.max() + 1)])
    assert len(centres) > 1 and (((x[:, None] - centres[None]) ** 2).sum(2).argmin(1) == lab).all()


def test_kprototypes_finds_planted_groups(spark, sf):
    rng = np.random.default_rng(3)
    planted = [(i, float(rng.normal(4 * (i % 2), 0.5)), "uv"[i % 2] if rng.random() < 0.9 else "w", float(rng.normal())) for i in range(200)]
    d = spark.createDataFrame(planted, "row_id long, a double, c string, noise double")
    lab, proto = cluster.kprototypes(d, ["a"], ["c"], 2)
    pure = Counter((r.row_id % 2, r.cluster) for r in lab.collect())
    assert len(pure) == 2 and sum(pure.values()) == 200 and sorted(np.round(proto["num"][:, 0])) == [0, 4] and {*proto["cat"][:, 0]} == {"u", "v"}
    metrics, _ = cluster.kprototypes_grid(d, ["a"], ["c"], [2, 4])
    assert cluster.select_clustering(metrics).first().k == 2
    two = d.join(lab, "row_id").toPandas()
    from tarmac.operators.neighbours import gower

    g = gower(two[["a"]].to_numpy(), two[["a"]].to_numpy(), two[["c"]].to_numpy(object), two[["c"]].to_numpy(object), [two.a.max() - two.a.min()])
    assert metrics.where("k = 2").first().silhouette == pytest.approx(cluster.silhouette_sample(g, two.cluster.to_numpy()).mean(), abs=1e-9)
    got = run(spark, sf, "kprototypes_choice")
    assert len(got) == 1 and got.k[0] in (2, 3, 4) and got.method[0] == "kprototypes"


# series


def test_series_metrics(spark, sf):
    pairs = analysis._pairs(spark, sf).toPandas()
    keys = sorted({*pairs.i, *pairs.j})
    d = np.zeros((len(keys), len(keys)))
    for r in pairs.itertuples():
        d[keys.index(r.i), keys.index(r.j)] = d[keys.index(r.j), keys.index(r.i)] = r.d
    got = run(spark, sf, "series_metrics")
    assert sorted(zip(got.method, got.k, strict=True)) == [("hclust", 2), ("hclust", 6), ("pam", 4)]
    h = series.series_hclust(spark.createDataFrame(pairs), [2]).toPandas().set_index("key").cluster
    lab = np.array([h[k] for k in keys])
    s = []
    for i in range(len(keys)):
        own = d[i][(lab == lab[i]) & (np.arange(len(keys)) != i)]
        other = min(d[i][lab == g].mean() for g in set(lab) - {lab[i]})
        s.append((other - own.mean()) / max(own.mean(), other) if len(own) else 0.0)
    # heights of lowest common merges, by following each pair up the tree
    parent = {}
    for step, (a, b, height, _) in enumerate(cluster.linkage(d)):
        parent[a] = parent[b] = (len(keys) + step, height)

    def meet(i, j):
        above = {}
        while i in parent:
            i, above[i] = parent[i][0], parent[i][1]
        while True:
            j, height = parent[j]
            if j in above:
                return height

    pairs_of = [(i, j) for i in range(len(keys)) for j in range(i)]
    want = np.corrcoef([d[i, j] for i, j in pairs_of], [meet(i, j) for i, j in pairs_of])[0, 1]
    assert got[got.method == "hclust"].cophenetic.tolist() == pytest.approx([want] * 2, abs=1e-5) and got[got.method == "pam"].cophenetic.isna().all()
    mine = got[(got.method == "hclust") & (got.k == 2)].iloc[0]
    assert mine.silhouette == pytest.approx(np.mean(s), abs=1e-4) and mine.min_prop == pytest.approx(min(Counter(lab).values()) / len(lab), abs=1e-5)


# text


def test_documents_with_terms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id", text.clean(F.lower("text"), text.english(spark) + text.DOMAIN).alias("t")).collect()
    terms = {r.doc_id: {w for w in (r.t or "").split() if len(w) >= 3} for r in docs}
    often = {w for w, n in Counter(itertools.chain.from_iterable(terms.values())).items() if n >= 40}
    assert sorted(run(spark, sf, "documents_with_terms").doc_id) == sorted(i for i, t in terms.items() if t & often)


def test_topics_separate_two_subjects(spark):
    rng = np.random.default_rng(2)
    subjects = (["engine", "wheel", "brake", "tyre"], ["flour", "sugar", "butter", "oven"])
    docs = spark.createDataFrame([(i, " ".join(rng.choice(subjects[i % 2], 30))) for i in range(40)], "doc_id long, text string")
    counts = topics.dtm(docs, "text", min_docs=2)
    model, vectors, vocab = topics.lda(counts, 2, iters=30)
    terms = topics.topic_terms(model, vocab, spark, 4).collect()
    found = {t: {r.term for r in terms if r.topic == t} for t in (0, 1)}
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, subjects))
    main = {r.doc_id: r.topic for r in topics.main_topic(model, vectors).collect()}
    assert all(main[i] == main[i % 2] for i in range(40)) and main[0] != main[1]
    names = {r.topic: r.name.split() for r in topics.topic_names(topics.topic_terms(model, vocab, spark, 4), 4).collect()}
    assert all(set(names[t]) == found[t] for t in names)


@pytest.mark.parametrize("k", [2, 4])
def test_gibbs_finds_planted_topics(spark, k):
    """Subjects come back whole at K = 2 and 4, whatever the partitioning."""
    rng = np.random.default_rng(k)
    subjects = [[f"word{s}{i}" for i in range(6)] for s in range(k)]
    rows = [(i, " ".join(rng.choice(subjects[i % k], 25))) for i in range(30 * k)]
    counts = topics.dtm(spark.createDataFrame(rows, "doc_id long, text string"), "text", min_docs=2)
    model = topics.gibbs_lda(counts, k, sweeps=15)
    found = {}
    for r in model.terms(6).collect():
        found.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, subjects))
    shares = model.shares().toPandas()
    assert shares.groupby("doc_id").share.sum().to_numpy() == pytest.approx(1)
    main = shares.loc[shares.groupby("doc_id").share.idxmax()].set_index("doc_id").topic
    assert len(set(main)) == k and all(main[i] == main[i % k] for i in range(30 * k))
    again = topics.gibbs_lda(counts.repartition(7, "term"), k, sweeps=15)
    key = lambda m: {r.doc_id: (r.terms, r.z) for r in m.state.collect()}
    assert key(model) == key(again)


@pytest.mark.parametrize("k", [1, 3])
def test_gibbs_takes_any_vocabulary(spark, monkeypatch, k):
    """Terms beyond the broadcast list have their place in the model; the vocabulary and small parts of the counts give the same draws."""
    rng = np.random.default_rng(8)
    rows = [(i or None, " ".join(f"word{j:02}" for j in rng.integers(0, 12, 20) + 12 * (i % 3))) for i in range(45)]
    counts = topics.dtm(spark.createDataFrame(rows, "doc_id long, text string"), "text", min_docs=2)
    model = topics.gibbs_lda(counts, k, sweeps=3)
    monkeypatch.setattr(topics, "MOST_TERMS", 4)
    monkeypatch.setattr(topics, "TERMS_AT_ONCE", 5)
    few = topics.gibbs_lda(counts.repartition(5, "term"), k, sweeps=3)
    key = lambda m: {r.doc_id: (r.terms, r.z) for r in m.state.collect()}
    assert key(model) == key(few) and (model.counts == few.counts).all() and model.counts.sum() == 900 and len(model.counts) == 36
    state, names = few.state.toPandas(), {r.i: r.term for r in few.vocab.collect()}
    want = Counter((names[i], z) for ts, zs in zip(state.terms, state.z, strict=True) for i, z in zip(ts, zs, strict=True))
    assert all(few.counts[i, z] == want[names[i], z] for i in names for z in range(k))
    assert Counter(names[i] for ts in state.terms for i in ts) == Counter(w for _, x in rows for w in x.split())
    often = sorted(names, key=lambda i: (-few.counts[i].sum(), names[i]))
    assert often == sorted(names) and few.terms(36).count() == 36 * k


def test_gibbs_numbers_follow_from_document_and_key():
    h, size = np.array([5, -9, 2**62, 0]), np.array([40_000, 0, 3, 40_000])
    u = topics._uniform(h, size, 11)
    assert [len(x) for x in u] == size.tolist() and all((x == y).all() for x, y in zip(topics._uniform(h[::-1], size[::-1], 11)[::-1], u, strict=True))
    for x in (u[0], u[3], topics._uniform(h, size, 12)[0]):
        assert 0 <= x.min() and x.max() < 1 and np.abs(np.histogram(x, 10, (0, 1))[0] / 4000 - 1).max() < 0.06 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.02
    assert abs(np.corrcoef(u[0], u[3])[0, 1]) < 0.02 and abs(np.corrcoef(u[0], topics._uniform(h, size, 12)[0])[0, 1]) < 0.02


def test_gibbs_draws_against_a_plain_loop():
    rng = np.random.default_rng(1)
    size, k, v = [7, 0, 12, 1], 3, 5
    terms, z, u = ([f(n) for n in size] for f in (lambda n: rng.integers(0, v, n), lambda n: rng.integers(0, k, n), rng.random))
    table = np.zeros((v, k))
    for t, y in zip(terms, z, strict=True):
        np.add.at(table, (t, y), 1)
    for t, y, d, got in zip(terms, z, u, topics._drawn(terms, z, u, table, 0.2, 0.1), strict=True):
        now = y.tolist()
        for i, w in enumerate(t):
            p = []
            for j in range(k):
                own = sum(x == j for m, x in enumerate(now) if m != i)
                p.append((own + 0.2) * (table[w, j] - (y[i] == j) + 0.1) / (table[:, j].sum() - (y[i] == j) + v * 0.1))
            now[i] = next((j for j in range(k) if d[i] * sum(p) < sum(p[: j + 1])), k - 1)
        assert now == got.tolist()


def test_topic_queries(spark, sf):
    terms = run(spark, sf, "topic_top_terms")
    for _, g in terms.groupby("topic"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1)) and list(g.weight) == sorted(g.weight, reverse=True)
        assert g.name.iloc[0].split() == list(g.term[:5]) if "name" in g else True
    shares = run(spark, sf, "document_topics")
    assert shares.groupby("doc_id").share.sum().to_numpy() == pytest.approx(1, abs=1e-4) and set(shares.topic) == {0, 1, 2, 3}
    scan = run(spark, sf, "topic_count_scan")
    assert sorted(scan.k) == [2, 4, 6] and scan.mean_cosine.between(0, 1).all() and scan.mean_divergence.between(0, math.log(2) + 1e-6).all()


def test_topic_queries_use_all_documents_and_terms(spark, sf, monkeypatch):
    """The models of document_topics and topic_count_scan take steps of a whole corpus, as many as the model asks for, and leave no term out."""
    from pyspark.ml.clustering import LDA

    seen, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, d: seen.append((self, fit(self, d))) or seen[-1][1])
    run(spark, sf, "document_topics")
    run(spark, sf, "topic_count_scan")
    terms = analysis._terms(spark, sf).select("term").distinct().count()
    assert [(x.getK(), x.getMaxIter(), x.getSubsamplingRate(), m.vocabSize()) for x, m in seen] == [(k, 50, 1.0, terms) for k in (4, 2, 4, 6)]


def test_rare_terms_are_in_the_models(spark):
    pairs = spark.range(20_100).select(F.explode(F.array(F.col("id") % 50, F.col("id") % 50 + 50)).alias("doc_id"), F.concat(F.lit("t"), "id").alias("term"), F.lit(1).cast("long").alias("tf"))
    model, vectors, vocab = topics.lda(pairs, 2, iters=2)
    assert topics.topic_terms(model, vocab, spark, 30_000).where("topic = 0").select("term").distinct().count() == 20_100 == len(vocab)
    assert vectors.count() == 100 and {r.features.numNonzeros() for r in vectors.collect()} == {402}


def test_stop_words_of_the_caller(spark):
    c = spark.createDataFrame([("The red Car and a bus",)], "t string")
    assert c.select(text.clean(F.col("t"), ["car"])).first()[0] == "the red and bus" and "the" in text.english(spark) and "red" not in text.english(spark)
    assert c.select(text.clean(F.col("t"), text.english(spark))).first()[0] == "red car bus"


# space


def test_corners_surround_their_cell(spark):
    d = spark.createDataFrame([("0_0",), ("3_-2",), ("-7_5",)], "cell string")
    inside = d.withColumn("corner", F.explode(spatial.hex_boundary(F.col("cell")))).groupBy("cell").agg(F.collect_list("corner").alias("c"), F.avg("corner.lat").alias("lat"), F.avg("corner.lng").alias("lng"))
    near = inside.withColumn("corner", F.explode("c")).select("cell", (F.col("lat") + 0.97 * (F.col("corner.lat") - F.col("lat"))).alias("lat"), (F.col("lng") + 0.97 * (F.col("corner.lng") - F.col("lng"))).alias("lng"))
    got = near.select("cell", spatial.hex_cell(F.col("lat"), F.col("lng")).alias("at")).collect()
    assert len(got) == 18 and all(r.cell == r["at"] for r in got)
    far = inside.withColumn("corner", F.explode("c")).select("cell", spatial.hex_cell(F.col("lat") + 1.03 * (F.col("corner.lat") - F.col("lat")), F.col("lng") + 1.03 * (F.col("corner.lng") - F.col("lng"))).alias("at")).collect()
    assert all(r.cell != r["at"] for r in far)


def test_texts_are_cut_once(spark):
    """A topic model reads written counts and vectors, however many rounds it takes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    docs = spark.createDataFrame([(i, "storm rain wind" if i % 2 else "bread salt oven") for i in range(40)], "doc_id long, text string")
    _, vectors, vocab = topics.lda(topics.dtm(docs.withColumn("text", noted("text")), "text", min_docs=2), 2, iters=3)
    assert vectors.count() == 40 and sorted(vocab) == ["bread", "oven", "rain", "salt", "storm", "wind"] and seen.value == 40


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


def test_pairs_of_documents_and_terms_stay_in_place(spark):
    """Terms are counted inside their rows: what moves are ids and terms, not pairs."""
    docs = spark.createDataFrame([(i, " ".join(f"word{(i + j) % 100}" for j in range(80))) for i in range(400)], "doc_id long, text string").repartition(2).localCheckpoint()
    before = shuffled(spark)
    assert topics.dtm(docs, "text", min_docs=2).count() == 400 * 80
    assert shuffled(spark) - before < 2000


@pytest.mark.parametrize("most", [0, 3, 200_000])
def test_terms_of_ids_on_several_rows(spark, monkeypatch, most):
    """Rows of one id, also of none, count as one document, whether the list of terms is broadcast or not."""
    monkeypatch.setattr(topics, "MOST_TERMS", most)
    rng = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else i % 40, None if i == 11 else " ".join(rng.choice([f"w{j}x" for j in range(30)] + ["ab", "", "\t\n"], rng.integers(0, 12)))) for i in range(60)]
    want = Counter((i, w) for i, x in rows if x for w in x.split() if len(w) >= 3)
    docs = Counter(w for _, w in want)
    got = topics.dtm(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text", min_docs=6)
    assert got.columns == ["doc_id", "term", "tf"] and dict(got.dtypes)["tf"] == "bigint"
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={i}, term={w!r}, tf={n})" for (i, w), n in want.items() if docs[w] >= 6) and 3 < sum(n >= 6 for n in docs.values()) < 30


def test_draws_of_documents_in_groups():
    """Any grouping of documents gives the same draws; groups take a bounded number of tokens beside their last document."""
    rng = np.random.default_rng(3)
    size = np.r_[rng.integers(0, 30, 50), 400, 0]
    terms, z, draws = ([f(n) for n in size] for f in (lambda n: rng.integers(0, 9, n), lambda n: rng.integers(0, 3, n), rng.random))
    table = rng.integers(1, 50, (9, 3)).astype(float) + 400
    whole, parts = topics._drawn(terms, z, draws, table, 0.2, 0.1), topics._parts(size, 100)
    assert sorted(np.concatenate(parts)) == list(range(52)) and all(size[at].sum() - size[at].min() <= 100 or len(at) == 1 for at in parts) and len(parts) > 3
    for at in parts:
        for i, got in zip(at, topics._drawn([terms[i] for i in at], [z[i] for i in at], [draws[i] for i in at], table, 0.2, 0.1), strict=True):
            assert (got == whole[i]).all() and len(got) == size[i]


def test_first_axes_of_many_terms(spark, monkeypatch):
    """Scans that multiply vectors find the axes of the matrix of terms, in groups of few cells and from a new start; no table is joined."""
    rng = np.random.default_rng(4)
    cells = [(i, f"t{j}", int(n)) for i, row in enumerate(rng.poisson(rng.gamma(0.4, 1.5, (90, 45)) + 0.15 * (np.arange(90) % 3 == 0)[:, None])) for j, n in enumerate(row) if n]
    counts = spark.createDataFrame(cells, "doc_id long, term string, tf long")
    monkeypatch.setattr(factor, "ca_sparse", None)
    monkeypatch.setattr(factor, "CELLS_AT_ONCE", 200)
    monkeypatch.setattr(factor, "BLOCKS", 3)
    eig, terms, docs = (x.toPandas() for x in factor.ca_text(counts, 2, most_terms=10))
    want, wanted_terms, wanted_docs = (x.toPandas() for x in factor.ca_text(counts, 2))
    assert np.allclose(eig[["eigenvalue", "percent", "cumulative"]], want[["eigenvalue", "percent", "cumulative"]][:2], atol=1e-8)
    both, both_docs = terms.merge(wanted_terms, on=["term", "axis"]), docs.merge(wanted_docs, on="doc_id")
    assert len(both) == 90 and len(both_docs) == 90 and np.allclose(both.contribution_x, both.contribution_y, atol=1e-4)
    for k in (1, 2):
        x, y = both_docs[f"dim_{k}_x"], both_docs[f"dim_{k}_y"]
        s = np.sign(x @ y)
        assert x[x.abs().argmax()] > 0 and np.allclose(x, s * y, atol=1e-5) and np.allclose(both[both.axis == k].coord_x, s * both[both.axis == k].coord_y, atol=1e-5)


def test_first_axes_of_a_large_vocabulary(spark, monkeypatch):
    """60,000 terms need no joins either; three groups of documents without common terms have two axes of eigenvalue 1, which tell the groups apart."""
    monkeypatch.setattr(factor, "ca_sparse", None)
    pairs = spark.range(60_000).select(F.explode(F.array(F.col("id") % 30, (F.col("id") * 7 + 3) % 30, F.col("id") % 3)).alias("doc_id"), F.concat(F.lit("t"), "id").alias("term")).distinct()
    eig, terms, docs = factor.ca_text(pairs.withColumn("tf", F.lit(2).cast("long")), 2)
    assert [r.eigenvalue for r in eig.orderBy("axis").collect()] == pytest.approx([1, 1], abs=1e-8) and terms.count() == 120_000
    got = docs.toPandas().set_index("doc_id").sort_index()
    assert len(got) == 30 and all(np.ptp(got.iloc[g::3].to_numpy(), axis=0).max() < 1e-6 for g in range(3))
    assert min(np.abs(got.iloc[a] - got.iloc[b]).max() for a, b in ((0, 1), (0, 2), (1, 2))) > 0.5


def test_first_axes_with_little_held(spark, monkeypatch):
    """Three blocks of vectors and many parts of a product give the axes of the matrix of terms; an id of none is a document."""
    rng = np.random.default_rng(6)
    cells = [(i or None, f"t{j}", int(n)) for i, row in enumerate(rng.poisson(rng.gamma(0.4, 1.5, (80, 50)) + 0.1)) for j, n in enumerate(row) if n]
    counts = spark.createDataFrame(cells, "doc_id long, term string, tf long").repartition(3)
    monkeypatch.setattr(factor, "HELD", 1)
    monkeypatch.setattr(factor, "TERMS_AT_ONCE", 7)
    eig, terms, docs = (x.toPandas() for x in factor.ca_text(counts, 2, most_terms=10))
    want, wanted_terms, wanted_docs = (x.toPandas() for x in factor.ca_text(counts, 2))
    assert np.allclose(eig[["eigenvalue", "percent", "cumulative"]], want[["eigenvalue", "percent", "cumulative"]][:2], atol=1e-8)
    both, both_docs = terms.merge(wanted_terms, on=["term", "axis"]), docs.merge(wanted_docs, on="doc_id")
    assert len(both) == 100 and len(both_docs) == 80 and docs.doc_id.isna().sum() == 1 and np.allclose(both.contribution_x, both.contribution_y, atol=1e-4)
    assert all(np.allclose(both_docs[f"dim_{k}_x"].abs(), both_docs[f"dim_{k}_y"].abs(), atol=1e-5) for k in (1, 2))


def test_base_rows_are_made_once(spark, sf):
    """What fits read again and again is a written table, not the view with its patterns."""
    assert all("base-rows" in f for f in analysis.base_rows(spark, sf).inputFiles())
