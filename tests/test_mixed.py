"""Silhouettes, neighbours and clusters by mixed distance against brute force over pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.operators import cluster, impute, mixed
from tarmac.operators.neighbours import gower


def table(n, seed=1, nulls=True):
    """Numbers with ties and a constant one, labels with a hot level, missing values in any column, rows without any value."""
    rng = np.random.default_rng(seed)
    gone = lambda x, p: [None if nulls and rng.random() < p else v for v in x]
    return pd.DataFrame({"row_id": np.arange(n), "a": gone(rng.integers(0, 12, n).astype(float).tolist(), 0.1), "b": gone(rng.normal(0, 1e6, n).tolist(), 0.2), "one": gone([3.0] * n, 0.5), "s": gone(rng.choice(["x", "x", "x", "y", "z"], n).tolist(), 0.1), "t": gone([f"t{i}" for i in rng.integers(0, 40, n)], 0.2), "g": rng.choice([0, 0, 0, 1, 2], n)})


NUM, CAT = ["a", "b", "one"], ["s", "t"]
KIND = "row_id long, a double, b double, one double, s string, t string, g int"


def distances(p):
    x = p[NUM].to_numpy(float)
    r = [float(np.nanmax(c) - np.nanmin(c)) if (~np.isnan(c)).any() else 0.0 for c in x.T]
    return gower(x, x, p[CAT].to_numpy(object), p[CAT].to_numpy(object), r), r


def spark_table(spark, p):
    return spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in p.itertuples(index=False, name=None)], KIND)


@pytest.mark.parametrize("n, each, full", [(2000, 32, ["one", "t"]), (200, 6, ["a", "one", "t"])])
def test_silhouettes_match_brute_force(spark, monkeypatch, n, each, full):
    monkeypatch.setattr(mixed, "PASS", each)
    p = table(n)
    p[full] = table(n, nulls=False)[full]
    p.loc[7, "g"] = 9  # a label of one row
    p.loc[[3, 11], [*NUM, *CAT]] = None
    d, _ = distances(p)
    want = cluster.silhouette_sample(d, p.g.to_numpy())
    got = mixed.gower_silhouettes(spark_table(spark, p), NUM, CAT, "g").toPandas().set_index("row_id").sort_index()
    assert np.allclose(got.silhouette, want, atol=1e-9) and got.silhouette[7] == 0 and len(got) == n
    assert mixed.gower_silhouette(spark_table(spark, p), NUM, CAT, "g") == pytest.approx(want.mean())


@pytest.mark.parametrize("most, piece", [(1 << 20, 16_384), (1000, 60)])
def test_silhouettes_of_labellings_share_their_passes(spark, monkeypatch, most, piece):
    """Rows move only where a bucket holds several values, once a column for all labellings, and sums stay exact."""
    monkeypatch.setattr(mixed, "MOST_SUMS", most)
    monkeypatch.setattr(mixed, "PIECE", piece)
    p = table(1200, seed=4)
    p["h"] = np.random.default_rng(9).choice([0, 1, 2, 3], len(p))
    p["s"] = [f"s{i % 700}" for i in range(len(p))]
    d, _ = distances(p)
    df = spark_table(spark, p.drop(columns="h")).join(spark.createDataFrame(p[["row_id", "h"]]), "row_id")
    want = [cluster.silhouette_sample(d, p[c].to_numpy()).mean() for c in ("g", "h")]
    assert mixed.mean_silhouettes(df, NUM, CAT, ["g", "h"]) == pytest.approx(want, abs=1e-12)
    out, _ = mixed._silhouettes(df, NUM, CAT, ["g", "h"], "row_id")
    moves = out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas")
    assert moves == (0 if most > 1000 else 4)  # b, s, t and a too, of few buckets; the constant column never


def test_silhouettes_of_odd_tables(spark):
    p = spark_table(spark, table(50, nulls=False)).withColumns({"label": F.lit("same"), "__key": F.lit(1), "none": F.lit(None).cast("string")})
    one = mixed.gower_silhouettes(p, NUM, CAT, "label").collect()
    assert len(one) == 50 and all(r.silhouette is None and r.b is None and r.a > 0 for r in one)
    assert mixed.gower_silhouettes(p, NUM, CAT, "none").count() == mixed.gower_silhouettes(p.limit(0), NUM, CAT, "g").count() == 0
    assert mixed.gower_silhouettes(p, [], ["s"], "g").count() == mixed.gower_silhouettes(p, ["a"], [], "g").count() == 50


@pytest.mark.parametrize("cells, cell, block", [(16_384, 4096, 16_384), (64, 50, 40), (4, 20, 300)])
def test_neighbours_match_brute_force(spark, monkeypatch, cells, cell, block):
    """All donors, ties in the order of keys, with many cells, with few, and with labels that cells don't tell apart."""
    for name, value in (("MOST_CELLS", cells), ("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(mixed, name, value)
    p = table(1500, seed=2)
    p = pd.concat([p, p.iloc[:200].assign(row_id=np.arange(1500, 1700))], ignore_index=True)  # equal rows
    _, r = distances(p)
    asks = p.row_id % 5 == 0
    x, c = p[NUM].to_numpy(float), p[CAT].to_numpy(object)
    d = gower(x[asks], x[~asks], c[asks], c[~asks], r)
    df = spark_table(spark, p)
    got = mixed.nearest_mixed(df.where("row_id % 5 = 0"), df.where("row_id % 5 <> 0"), NUM, CAT, "g", 5, r).toPandas().set_index("row_id").near
    keys = p.row_id[~asks].to_numpy()
    assert len(got) == asks.sum()
    for i, q in enumerate(p.row_id[asks]):
        order = np.lexsort((keys, np.round(d[i], 12)))[:5]
        assert np.allclose([n["d"] for n in got[q]], d[i][order], atol=1e-12)
        assert [n["key"] for n in got[q]] == keys[order].tolist() and [n["value"] for n in got[q]] == p.g[~asks].to_numpy()[order].tolist()


def test_donors_of_odd_tables(spark):
    df = spark_table(spark, table(60, seed=4)).withColumns({"near": F.lit("mine"), "q": F.lit(1)})
    numbers = impute.impute_knn(df, "a", ["b"], ["s"])
    assert numbers.columns == df.columns and numbers.where("a is null").count() == 0
    assert impute.impute_knn(df, "s", ["a"], ["t"]).where("s is null").count() == 0
    none = df.withColumn("a", F.lit(None).cast("double"))
    assert impute.impute_knn(none, "a", ["b"], ["s"]).where("a is null").count() == 60  # no donors
    few = df.where("a is not null").limit(2).unionByName(df.where("a is null").limit(3))
    assert impute.impute_knn(few, "a", ["b"], []).where("a is null").count() == 0
    assert impute.impute_knn(df.limit(0), "a", ["b"], ["s"]).count() == 0


def test_blocks_without_donors_or_rows_that_ask(spark, monkeypatch):
    """Rows are dealt to blocks by hash, so of many small blocks some are empty on one side."""
    monkeypatch.setattr(mixed, "BLOCK", 1)
    df = spark.createDataFrame([(i, float(i), "x") for i in range(60)], "row_id long, a double, s string")
    got = mixed.nearest_mixed(df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1"), ["a"], ["s"], "a", 2, [59.0]).collect()
    assert {r.row_id: [n["key"] for n in r.near] for r in got} == {i: [1, 3] if i == 0 else [i - 1, i + 1] for i in range(0, 60, 2)}


# chained imputation with labels


def plain_multinomial(x, y, k, w, ridge=1e-6):
    """Newton on the whole table at once, on z-scores."""
    mean, sd = np.average(x, 0, w), np.sqrt(np.average((x - np.average(x, 0, w)) ** 2, 0, w))
    m = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b, one = np.zeros((k - 1) * m.shape[1]), np.eye(k)[y]
    pen = np.tile(np.r_[0, np.full(x.shape[1], ridge * w.sum())], k - 1)
    for _ in range(50):
        z = np.column_stack([np.zeros(len(x)), m @ b.reshape(k - 1, -1).T])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.concatenate([m.T @ (w * (one[:, i] - p[:, i])) for i in range(1, k)]) - pen * b
        h = np.block([[m.T @ (m * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]) for j in range(1, k)] for i in range(1, k)])
        b = b + np.linalg.solve(h + np.diag(pen), g)
    out = np.vstack([np.zeros(m.shape[1]), b.reshape(k - 1, -1)])
    out[:, 1:] /= sd
    out[:, 0] -= out[:, 1:] @ mean
    return out


def labelled(n=400, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal([3, -100], [1, 40], (n, 2))
    z = np.column_stack([np.zeros(n), x[:, 0] - 3, (x[:, 1] + 100) / 30])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    return x, np.array([rng.choice(3, p=r) for r in p]), rng.integers(0, 3, n).astype(float)


def test_multinomial_fit_equals_a_dense_solver(spark):
    x, y, w = labelled()
    rows = spark.createDataFrame([(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, y, w, strict=True)], "a double, b double, y int, w double").repartition(3)
    assert np.allclose(impute.multinomial(rows, ["a", "b"], "y", 3, "w"), plain_multinomial(x, y, 3, w), rtol=1e-6, atol=1e-9)
    apart = rows.withColumn("y", (F.col("a") > 3).cast("int"))  # levels that can be told apart: finite, and right
    beta = impute.multinomial(apart, ["a", "b"], "y", 2)
    assert np.isfinite(beta).all() and ((np.column_stack([np.ones(len(x)), x]) @ beta[1] > 0) == (x[:, 0] > 3)).all()


def test_canonical_variate_separates_levels():
    x, y, _ = labelled(4000)
    d = np.eye(3)[y][:, 1:]
    m = np.column_stack([np.ones(len(x)), x, d])
    b = impute.canonical(m.T @ m, 2)
    score = x @ b
    group = np.stack([score[y == g].mean() for g in range(3)])
    r2 = sum((y == g).sum() * (group[g] - score.mean()) ** 2 for g in range(3)) / ((score - score.mean()) ** 2).sum()
    for angle in np.linspace(0, np.pi, 60):  # no other combination tells the levels apart better
        other = x / x.std(0) @ [np.cos(angle), np.sin(angle)]
        means = np.stack([other[y == g].mean() for g in range(3)])
        assert sum((y == g).sum() * (means[g] - other.mean()) ** 2 for g in range(3)) / ((other - other.mean()) ** 2).sum() <= r2 + 1e-9


def test_bootstrap_weights_are_those_of_a_sample_with_replacement(spark):
    got = spark.range(20_000).select(impute.poisson_weight("id", 1, "x").alias("w")).groupBy("w").count().collect()
    share = {int(r.w): r["count"] / 20_000 for r in got}
    assert [share[k] for k in range(4)] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=0.012)


def test_partial_matrices_add_up_alike_in_any_order(spark):
    parts = [(0, [0.1 * 3**i, -1e9 / 7**i]) for i in range(12)] + [(1, [1.0, 2.0])]
    one, other = (impute._added(spark.createDataFrame(x, "r int, g array<double>").coalesce(1), 2) for x in (parts, parts[::-1]))
    assert np.array_equal(one, other) and np.allclose(one, [np.sum([g for r, g in parts if r == i], 0) for i in (0, 1)])


@pytest.mark.parametrize("how", ["matching", "regression"])
def test_labels_are_filled_in_the_chain(spark, how):
    """Labels that follow from numbers come back, what was observed stays, and two runs agree."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 600), rng.normal(0, 1, 600)
    s = np.where(a < -0.4, "low", np.where(a < 0.4, "mid", "high"))
    lost = rng.random(600) < 0.15
    rows = [(i, None if i % 11 == 3 else float(a[i]), float(b[i]), None if lost[i] else str(s[i]), None, "k" if i % 2 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, s string, none string, one string")
    cols = ["a", "b", "s", "none", "one"]
    run = lambda: (impute.impute_pmm(df, cols, sweeps=2, bootstrap=True) if how == "matching" else impute.impute_chained(df, cols, bootstrap=True)).toPandas().set_index("row_id").sort_index()
    got = run()
    assert list(got.columns) == df.columns[1:] and got[["a", "b", "s"]].notna().all().all() and got.none.isna().all() and (got.one == "k").all()
    assert (got.s[~lost] == s[~lost]).all() and np.allclose(got.a[[i % 11 != 3 for i in range(600)]], a[[i % 11 != 3 for i in range(600)]])
    known = lost & np.array([i % 11 != 3 for i in range(600)])
    assert (got.s[known] == s[known]).mean() > 0.75
    assert got.equals(run())


# clusters of large samples


def test_cure_finds_planted_groups_of_many_rows(spark, monkeypatch):
    """The whole share of each stratum takes part, in rounds of small chunks, and no chunk or matrix grows with the table."""
    n = 60_000
    h = lambda i: F.pmod(F.xxhash64("row_id", F.lit(i)), F.lit(1000)) / 1000.0
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("state"), F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 1).otherwise(2).alias("g"))
    df = df.withColumns({"a": h(1) + F.when(F.col("g") == 1, 4.0).otherwise(0.0), "b": h(2) + F.when(F.col("g") == 2, 4.0).otherwise(0.0), "c": F.when(F.col("g") == 1, "u").otherwise("v")})
    seen, joined = [], cluster._joined
    monkeypatch.setattr(cluster, "CHUNK", 128)
    monkeypatch.setattr(cluster, "_joined", lambda m, *a: (seen.append(m["__part"].nunique()), joined(m, *a))[1])
    got = cluster.cure_mixed(df, ["a", "b"], ["c"], "state", 3).join(df.select("row_id", "g"), "row_id").groupBy("cluster", "g").count().collect()
    assert {(r.cluster, r.g): r["count"] for r in got} == {(0, 0): n * 7 // 10, (1, 1): n // 5, (2, 2): n // 10}
    assert max(seen) <= 128


def test_cure_of_one_chunk_is_average_linkage(spark):
    p = table(150, seed=9, nulls=False)
    df = spark_table(spark, p)
    got = cluster.cure_mixed(df, NUM, CAT, "s", 4, frac=1.0).toPandas().set_index("row_id").sort_index()
    d, r = distances(p)
    want = cluster.cut(cluster.linkage(d, "average"), 150, 4)
    assert len(got) == 150 and got.cluster.nunique() == len(set(want))
    reps = []
    for g in range(4):
        at = np.flatnonzero(want == g)
        reps += [(at[i], g) for i in cluster.spread(d[np.ix_(at, at)], np.ones(len(at)), 5)]
    near = np.array([g for _, g in reps])[d[:, [i for i, _ in reps]].argmin(1)]
    agree = pd.crosstab(got.cluster.to_numpy(), near).to_numpy()
    assert agree.max(1).sum() > 145  # but for rows that are as near to two groups
    assert cluster.cure_mixed(df.limit(0), NUM, CAT, "s", 4).count() == 0


def test_chunks_of_cure_are_tasks_of_their_own(spark, monkeypatch):
    """Chunks are few bytes: left to the sizes of shuffles, one task would merge them all."""
    monkeypatch.setattr(cluster, "CHUNK", 64)
    monkeypatch.setattr(cluster, "PARTIAL", 4)
    tasks, merged = [], cluster.staged

    def seen(df, name):
        out = merged(df, name)
        tasks.extend([len(out.inputFiles())] if name == "cure-clusters" else [])
        return out

    monkeypatch.setattr(cluster, "staged", seen)
    p = spark_table(spark, table(900, nulls=False))
    assert cluster.cure_mixed(p, NUM, CAT, "s", 2, frac=1.0).count() == 900
    assert tasks[0] > 4


def test_prototypes_are_summed_in_one_scan(spark):
    """Means and most frequent levels (the smallest of ties) of the rows nearest to each prototype."""
    p = table(500, nulls=False)
    lab, proto = cluster.kprototypes(spark_table(spark, p), NUM, CAT, 3, max_iter=60)
    mine = p.assign(cluster=lab.toPandas().set_index("row_id").cluster.sort_index())
    for g, rows in mine.groupby("cluster"):
        assert np.allclose(proto["num"][g], rows[NUM].mean()) and list(proto["cat"][g]) == [rows[c].mode().min() for c in CAT]
