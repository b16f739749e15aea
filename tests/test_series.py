"""Hierarchies merged in rounds against single merges on a matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import cluster, series


def table(spark, d, names=None):
    names = names or [int(i) for i in range(len(d))]
    rows = [(names[i], names[j], float(d[i, j])) if (i + j) % 2 else (names[j], names[i], float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))]
    return spark.createDataFrame(rows, f"i {'string' if isinstance(names[0], str) else 'long'}, j {'string' if isinstance(names[0], str) else 'long'}, d double")


def random_distances(n, seed):
    d = np.random.default_rng(seed).random((n, n))
    d = d + d.T
    np.fill_diagonal(d, 0)
    return d


def meeting_heights(merges, n):
    out, inside = np.zeros((n, n)), {i: [i] for i in range(n)}
    for step, (a, b, height, _) in enumerate(merges):
        left, right = inside.pop(a), inside.pop(b)
        for x in left:
            for y in right:
                out[x, y] = out[y, x] = height
        inside[n + step] = left + right
    return out


@pytest.mark.parametrize(("method", "few"), [("ward", 1), ("average", 5), ("ward", 1000), ("average", 1000)])
def test_rounds_give_the_tree_of_single_merges(spark, method, few):
    d = random_distances(24, 5)
    pairs, merges = table(spark, d), cluster.linkage(d, method)
    tree = series.hierarchy(pairs, method, few)
    rows = tree.collect()
    assert sorted(r.height for r in rows) == pytest.approx([m[2] for m in merges], abs=1e-9)
    assert sorted(r["item"] for r in rows) == list(range(1, 24)) and all(r.into < r["item"] for r in rows)
    want = meeting_heights(merges, 24)
    got = series.cophenetic(pairs, tree).collect()
    assert len(got) == 276 and all(r.height == pytest.approx(want[r.i, r.j], abs=1e-9) for r in got)
    ks = [1, 2, 7, 24, 25]
    labels = {(r.k, r.key): r.cluster for r in series.series_hclust(pairs, ks, method, few).collect()}
    assert labels == {(k, i): int(c) for k in ks[:4] for i, c in enumerate(cluster.cut(merges, 24, k))}


def test_chains_ties_and_names(spark):
    # each item is nearest to its left neighbour, so one pair is merged in a round
    at = np.cumsum(1 + 0.01 * np.arange(6))
    d = np.abs(at[:, None] - at[None, :])
    rows = series.hierarchy(table(spark, d), "average", 1).collect()
    assert sorted(r.height for r in rows) == pytest.approx([m[2] for m in cluster.linkage(d, "average")])
    # copies at distance 0 and equal distances: a whole tree, copies together
    same = np.ones((6, 6)) - np.kron(np.eye(3), np.ones((2, 2)))
    pairs = table(spark, same, list("fabecd"))
    labels = {r.key: r.cluster for r in series.series_hclust(pairs, [3], "average", 1).collect()}
    assert [labels["f"], labels["b"], labels["c"]] == [labels["a"], labels["e"], labels["d"]] and sorted(set(labels.values())) == [0, 1, 2]
    assert [r.height for r in series.hierarchy(pairs, "average", 1).orderBy("height").collect()] == [0, 0, 0, 1, 1]


def test_tables_that_are_not_whole(spark):
    pairs = table(spark, random_distances(5, 1))
    for bad in (pairs.where("not (i = 0 and j = 1)"), pairs.union(pairs.limit(1)), pairs.withColumn("d", F.when(F.col("i") != 1, F.col("d")))):
        with pytest.raises(ValueError):
            series.hierarchy(bad)
    none = pairs.limit(0)
    assert series.hierarchy(none).count() == 0 and series.series_hclust(none, [1, 2]).count() == 0
    two = table(spark, random_distances(2, 1))
    assert sorted((r.k, r.key, r.cluster) for r in series.series_hclust(two, [1, 2, 3]).collect()) == [(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 1)]


def test_metrics_of_one_cluster_and_single_items(spark):
    d = random_distances(6, 2)
    pairs = table(spark, d)
    lab = {("a", 1): [0] * 6, ("b", 3): [0, 0, 1, 1, 1, 2]}
    frames = {m: spark.createDataFrame(list(enumerate(y)), "key long, cluster int") for m, y in lab.items()}
    got = {(r.method, r.k): r for r in series.ts_metrics(pairs, frames, {"b": "average"}).collect()}
    assert got["a", 1].silhouette == 0 and got["a", 1].cophenetic is None and got["b", 3].imbalance == 3
    assert got["b", 3].silhouette == pytest.approx(cluster.silhouette_sample(d, np.array(lab["b", 3])).mean(), abs=1e-9)
    up = np.triu_indices(6, 1)
    assert got["b", 3].cophenetic == pytest.approx(np.corrcoef(d[up], meeting_heights(cluster.linkage(d, "average"), 6)[up])[0, 1])
