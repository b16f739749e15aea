"""URL filters, hard negatives and centroid clustering against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import fagin, simplex, topk, urls

# op11

ODD = [None, "", "no scheme", "://", "http://", "HTTP://A.NET/x", "http://NET/", "http://net", "http://anet/", "http://a.net?x=/y", "http://a.b.example.net/en/1", "http://example.net/EN/", "x://é.ORG/fr/#a?b", "a://b://c/d", "http://ÀB.example.com/de/ü\n?q", "http://h\n.net/", "http://x.org/fr", "u" * 20_000 + "://long.net/" + "p" * 20_000]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    found = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(found)[1:] if found else (None, None))


def plain_buckets(host, path):
    out = []
    for text, salt in ((host, 1), (path, urls.PATH)):
        if text:
            codes = [ord(c) for c in f"^{text}$"]
            out += [(sum(c * p for c, p in zip(codes[i : i + n], urls.PRIMES)) + salt * n) % urls.BUCKETS for n in urls.NGRAMS for i in range(len(codes) - n + 1)]  # noqa: B905
    return out


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_url_model_against_a_plain_loop(url_model):
    x = np.zeros((len(urls.labelled_rows()), urls.BUCKETS + 1))
    for i, (u, _) in enumerate(urls.labelled_rows()):
        grams = plain_buckets(*plain_url(u)[:2])
        np.add.at(x[i], grams, 1 / np.sqrt(len(grams)))
    x[:, -1] = 1
    y, w, v = np.array([k for _, k in urls.labelled_rows()]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(urls.STEPS):
        v = urls.MOMENTUM * v + x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) - urls.DECAY * np.append(w[:-1], 0)
        w = w + urls.RATE * v
    assert np.allclose([*url_model.weights, url_model.offset], w, atol=1e-6)
    assert ((x @ w > 0) == (y == 1)).mean() > 0.95


def test_urls_against_plain_rules(spark, url_model):
    pages = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(ODD)] + [(None, "http://a.net/", "mine", 1), (3, "://", "mine", 1)], "page_id long, url string, host string, __path int")
    pages = pages.withColumnRenamed("__path", "score")
    got = urls.judged(pages, url_model).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        host, path, rule, verdict = plain_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        grams = plain_buckets(host, path)
        z = url_model.offset + sum(url_model.weights[b] for b in grams) / np.sqrt(max(1, len(grams)))
        assert r.score == pytest.approx(z, abs=1e-9)
        assert r.verdict == (verdict or ("block" if z > 0 else "allow"))
    assert urls.judged(pages.limit(0), url_model).count() == 0


def test_urls_held_out_names(url_model, spark):
    names = [("mycasino", "block"), ("cheap-pills", "block"), ("free-bets", "block"), ("adult-films", "block"), ("gardening", "allow"), ("history-blog", "allow"), ("nature", "allow"), ("thread", "allow")]
    got = urls.judged(spark.createDataFrame([(f"http://www.{n}.example.com/en/{i}", v) for i, (n, v) in enumerate(names)], "url string, want string"), url_model).collect()
    assert [(r.url, r.verdict) for r in got] == [(r.url, r.want) for r in got]


def test_urls_of_odd_labels_and_many_rules(spark):
    nothing = urls.train(spark.createDataFrame([(None, 1), ("http://a/b", None), ("http://a/b", 7)], "url string, label int"))
    assert nothing.offset == 0 and not any(nothing.weights)
    assert urls.judged(spark.createDataFrame([("http://a/b",)], "url string"), nothing).first().verdict == "allow"
    with pytest.raises(ValueError, match="rules"):
        urls.rule_of(F.lit(""), F.lit(""), [("a", "/", "block")] * (urls.MOST_RULES + 1))


def test_urls_use_no_python(spark, sf):
    plan = urls.op11_url_filters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan) and "ReadSchema: struct<page_id:bigint,url:string>" in plan


# op12


def plain_negatives(rows, anchors):
    out = []
    usable = [r for r in rows if None not in r and len(r[2])]
    for a, la, va in [r for r in usable if r[0] in anchors]:
        s = [(-sum(int(x) * int(y) for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in usable if len(v) == len(va)]
        for neg, p, _ in sorted(x for x in s if x[2] == la and x[1] != a)[:5]:
            fits = sorted(x for x in s if x[2] != la and 30 * -neg <= 100 * -x[0] <= 90 * -neg)[:10]
            out += [(a, p, k + 1, i, -neg, -x) for k, (x, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("shard, anchors", [(1 << 20, 512), (8 * 6 * 16, 4)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, shard, anchors):
    """Ties, repeated vectors and ids, zero and negative scores, a hot label, short vectors and missing values; shards of any size."""
    monkeypatch.setattr(fagin, "SHARD", shard)
    monkeypatch.setattr(fagin, "ANCHORS", anchors)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.choice([0, 0, 1, 2, 3])), rng.integers(-4, 5, 6).tolist()) for i in range(300)]
    rows += [(300 + i, i % 2, [1, 2, 0, -1, 3, 1]) for i in range(120)] + [(420 + i, i % 4, rng.integers(3, 6, 2).tolist()) for i in range(30)]
    rows += [(450, 0, [0] * 6), (460, 0, [-9] * 6), (470, 9, [5] * 6), (10, 1, [2] * 6), (480, None, [1] * 6), (None, 1, [1] * 6), (490, 2, None), (500, 2, [])]
    df = spark.createDataFrame([(i, lab, None if v is None else [float(c) for c in v], "x", 1) for i, lab, v in rows], "id long, label long, v array<double>, shard string, n int")
    df = df.withColumn("v", F.when(F.size("v") > 0, F.col("v")))
    chosen = {i for i in range(0, 510, 10)}
    got = sorted(tuple(r) for r in fagin.hard_negatives(df.where("id % 10 = 0"), df).collect())
    assert got == plain_negatives(rows, chosen) and len(got) > 500


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "id long, label long, v array<double>")
    one = spark.createDataFrame([(1, 1, [1.0])], none.schema)
    assert fagin.hard_negatives(none, none).count() == fagin.hard_negatives(one, none).count() == fagin.hard_negatives(one, one).count() == 0


def test_threshold_ends_the_search_early():
    """Most vectors aren't scored where the lists are told apart, and what is left out could not have counted."""
    rng = np.random.default_rng(8)
    n = 4000
    x = np.floor(rng.exponential(40, (n, 5)) ** 1.5)
    shard = fagin.Shard(5, np.arange(n).tobytes(), np.zeros(n, np.int64).tobytes(), x.tobytes(), np.argsort(x, 0, kind="stable").T.astype(np.int16).tobytes())
    for sign in ([1, 1, 1, 1, 1], [1, -1, 1, 0, -1], [-1, -1, 0, 0, 0]):
        a = np.array(sign, float) * rng.integers(1, 9, 5)
        s = x @ a
        best = fagin.Best(5)
        scored = fagin.search(a, shard, np.ones(n, bool), [best])
        assert sorted(zip(-best.scores, best.ids)) == sorted(zip(-s, range(n)))[:5] and scored < n / 2  # noqa: B905


# op13


def plain_clusters(rows, k=16, rounds=3):
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centroids = [v for _, v in first[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return [(i, assign(v)[1], assign(v)[0]) for i, v in rows], centroids


@pytest.mark.parametrize("kind", ["spread", "grid", "same", "few", "line", "outlier"])
def test_clusters_match_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = {"spread": rng.integers(-60, 60, (400, 8)), "grid": rng.integers(0, 2, (300, 4)), "same": np.full((50, 3), 7), "few": rng.integers(-5, 5, (9, 4)), "line": np.outer(np.arange(200), [1, 2, -3]), "outlier": np.vstack([rng.integers(-9, 9, (200, 5)), [[1 << 26] * 5], [[-(1 << 26), 3, 1, 0, 1 << 25]]])}[kind]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(0, x[-1].tolist()), (None, x[0].tolist())]
    got, centroids = simplex.cluster(spark.createDataFrame(rows, "vec_id long, v array<long>"))
    want, mine = plain_clusters(rows)
    key = lambda r: (r[0] is None, r)
    assert centroids.tolist() == mine
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_bounds_hold_and_rule_centroids_out():
    rng = np.random.default_rng(9)
    centres = rng.integers(-200, 200, (16, 64))
    x = np.vstack([centres[i % 16] + rng.integers(-20, 20, 64) for i in range(500)] + [rng.integers(-(1 << 24), 1 << 24, (50, 64))])
    s = simplex.Simplex(centres)
    assert len(s.pivots) == simplex.PIVOTS
    a, c = s.apex(simplex.squared(x, s.pivots)), s.apex(simplex.squared(centres, s.pivots))
    low, high = simplex.bounds(a, c)
    true, slack = np.sqrt(simplex.squared(x, centres).astype(float)), s.slack(a)[:, None] + s.slack(c)[None, :]
    assert (low - slack <= true).all() and (true <= high + slack).all()
    assert simplex.nearest(x[:500], a[:500], centres, s)[2] < 16 * 500 / 2  # most centroids are out before a look at the vector
    d = simplex.squared(x, centres)
    cluster, best, _ = simplex.nearest(x, a, centres, s)
    assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all()


@pytest.mark.parametrize("query, cols", [(simplex.op13_centroid_clustering, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]), (fagin.op12_hard_negative_mining, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])])
def test_vector_queries_of_odd_tables(spark, tmp_path, query, cols):
    rows = [(100 * i, [float(i % 5), 1.0, *[0.01 * i] * 62], i % 3, "x", 1) for i in range(40)]
    rows += [(1, None, 1, "x", 1), (2, [], 1, "x", 1), (3, [1.0], None, "x", 1), (4, [float("nan")] * 64, 1, "x", 1), (5, [None] * 64, 1, "x", 1), (None, None, None, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string, n int")
    df.write.parquet(f"file://{tmp_path}/odd/embeddings.parquet")
    df.limit(0).write.parquet(f"file://{tmp_path}/none/embeddings.parquet")
    got = query(spark, f"file://{tmp_path}/odd")
    assert got.columns == cols and got.count() > 0
    if "cluster" in cols:
        assert got.count() == 40 and got.agg(F.sum("distance")).first()[0] == got.first().inertia
    none = query(spark, f"file://{tmp_path}/none")
    assert none.columns == cols and none.count() == 0


def test_levels_of_vectors(spark):
    got = spark.createDataFrame([([0.5, -0.26],)], "embedding array<double>").select(topk.quantised(levels=4).alias("v")).first().v
    assert got == [2.0, -2.0]
