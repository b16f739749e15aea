"""Classifiers by held-out accuracy; joins and searches against brute force; the pipeline as a whole."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarmac.llm import components, jaccard, labelled, packing, quality, rpforest, secrets, topk, toxicity
from tarmac.llm import text as words


def auc(score, label):
    pos, neg = (np.array([s for s, y in zip(score, label, strict=True) if y == k]) for k in (1, 0))
    return np.mean(pos[:, None] > neg[None, :]) + np.mean(pos[:, None] == neg[None, :]) / 2


def held_out(spark, sf, query, label):
    got = query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    return auc([r.score for r in got], [r[label] for r in got])


def test_quality_on_held_out_rows(spark):
    assert held_out(spark, "/root/testdata/sf0.01", quality.op4_quality_classifier, "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out(spark, "/root/testdata/sf0.01", toxicity.op9_toxicity, "toxic") > 0.85


def test_long_texts_do_not_end_the_sample(spark):
    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    first = ids.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").first().doc_id
    labels = ids.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    docs = ids.withColumn("text", F.repeat(F.lit("x"), F.when(F.col("doc_id") == first, 20_000).otherwise(100).cast("int")))
    rows, counts = labelled.training_rows(docs, labels, "quality", F.lit(True), max_bytes=10_000)
    assert counts == (20, 20) and sorted(r.y for r in rows.collect()) == sorted(i % 2 for i in range(40) if i != first)
    long = ids.withColumn("text", F.repeat(F.lit("x"), F.when(F.col("doc_id") % 2 == 1, 20_000).otherwise(100).cast("int")))
    with pytest.raises(ValueError, match="quality 1"):
        labelled.training_rows(long, labels, "quality", F.lit(True), max_bytes=10_000)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_of_odd_tables(spark, module):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "word " * 30000, 0.1), (3, "again", 0.1), (None, "x", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, none)
    out = module.score(docs, model).collect()
    assert len(out) == 5 and all(r.score == pytest.approx(0.5) for r in out)
    one = module.train(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int"))
    assert module.score(docs, one).first().score > 0.9
    assert module.score(docs.limit(0), model).count() == 0


def plain_mix(x):
    mask = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def plain_slice(raw):
    mask = (1 << 64) - 1
    return plain_mix((sum(int(words.CODES[b]) * pow(int(words.BASE), k, 1 << 64) for k, b in enumerate(raw)) + len(raw)) & mask)


def plain_quality(model, text):
    """One feature after the other: words, pairs of words, n-grams of bytes."""
    raw, mask = text.encode(), (1 << 64) - 1
    hashes = [plain_slice(w) for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    found = list(hashes)
    found += [1 if a == b else plain_mix((a * 0x9E3779B97F4A7C15 + b) & mask) for a, b in zip(hashes, hashes[1:])]  # noqa: B905
    for n in quality.NGRAMS:
        found += [((int.from_bytes(raw[i : i + n], "little") + n) * 0xD6E8FEB86659FD93) & mask for i in range(len(raw) - n + 1)]
    z = sum(float(model.table[f >> (64 - quality.BITS)]) for f in found) / (len(found) + quality.DAMPING)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30)))


def plain_toxicity(model, text):
    counts, z = {}, model.offset
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        for key in [plain_slice(w), *[plain_slice(w[:n]) + 1 for n in toxicity.PREFIX if len(w) > n]]:
            place = (key & ((1 << 64) - 1)) >> (64 - toxicity.BITS)
            counts[place] = counts.get(place, 0) + 1
    for place, n in counts.items():
        at = np.flatnonzero(model.places == place)
        if len(at):
            z += sum(model.weights[at[0], k] for k, least in enumerate(toxicity.LEVELS) if n >= least)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@pytest.mark.parametrize("module, query, plain, label, fold, cut", [(quality, "op4_quality_classifier", plain_quality, "quality", (4, 2), 0.7), (toxicity, "op9_toxicity", plain_toxicity, "toxic", (5, 0), 0.5)])
def test_scores_against_plain_loops(spark, tmp_path, module, query, plain, label, fold, cut):
    """The query's rows are those of a loop over features with the model that it fits, on whole texts of each kind."""
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150).select("doc_id", "text")
    odd = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "Ééé! moron morons MORON " * 4), (10_004, "a b a b b b"), (10_005, "word " * 3000), (None, "no id"), (10_006, "same"), (10_006, "same")]
    docs = some.union(spark.createDataFrame(odd, some.schema)).withColumns({"score": F.lit("x"), "__y": F.lit(1)})
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").join(some.select("doc_id"), "doc_id")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    model = module.train(docs.select("doc_id", "text"), labels)
    rows = getattr(module, query)(spark, f"file://{tmp_path}").collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        want = plain(model, text[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1])
    assert module.score(docs, model).columns == [*docs.columns] and dict(module.score(docs, model).dtypes)["score"] == "double"


def test_swaps_spare_neutral_mentions():
    rnd, texts, labels = random.Random(3), [], []
    for i in range(400):
        y = i % 4 == 0
        words = [rnd.choice(["tree", "house", "runs", "blue", "fast", "cat"]) for _ in range(12)] + ["moron"] * (y and rnd.random() < 0.6)
        if rnd.random() < (0.9 if y else 0.1):
            words.append("muslim")
        texts.append(" ".join(words))
        labels.append(int(y))
    gap = {}
    for swap in (0.0, 5.0):
        m = toxicity.fit(pa.array(texts), labels, swap=swap)
        a, b, c = m.scores(pa.array(["the cat with a muslim", "the cat with a christian", "cat moron"]))
        gap[swap] = abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))
        assert c > 0.5 > a
    assert gap[0.0] > 1 and gap[5.0] < 0.2
    assert toxicity.swapped("The Women and Muslim friends; menthol éwomen") == "The men and christian friends; menthol éwomen"


def brute_links(n, near):
    links, top = [0] * n, list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return links, [find(i) for i in range(n)]


def shingle_set(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_texts():
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 4) + str(rnd.randint(0, 99)) for _ in range(120)] for _ in range(6)]
    texts = [" ".join(b) for b in base for _ in range(3)]
    for b in base:
        for k in (1, 2, 3, 30):
            c = list(b)
            for _ in range(k):
                c[rnd.randrange(120)] = "new" + str(rnd.randint(0, 10**6))
            texts.append(" ".join(c))
    return [*texts, None, "", " ", "one two", "One  two", "a b c d e", *[" ".join([*base[0][:118], str(i), str(i)]) for i in range(700)]]


def test_jaccard_join_matches_brute_force(spark):
    texts = near_texts()
    sets = [shingle_set(t) for t in texts]
    jac = lambda i, j: bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    links, comp = brute_links(len(texts), jac)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, texts[0], 7)], "doc_id long, text string, node int")
    got = {r.doc_id: r for r in jaccard.link_documents(docs).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert all(got[i].kept == (comp[i] == i) for i in range(len(texts))) and got[None].kept
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(comp))
    assert jaccard.link_documents(docs.limit(0)).count() == 0


def test_repeated_ids_lose_no_text(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 99)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (3, c, "x"), (3, c, "y"), (3, c.upper(), "y"), (4, c + " more", "z"), (5, None, None), (5, " ", None), (None, c, "n"), (0, "one two", "q"), (0, c + " tail", "q"), (0, c + " more", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.node or "") for r in left.collect())
    kept_c = [g for g in got if g[0] == 0 and g[1] != "one two"]
    assert len(kept_c) == 1 and kept_c[0][1] in (c + " tail", c + " more")
    assert [g for g in got if g not in kept_c] == sorted([(-1, c, "n"), (0, "one two", "q"), (1, a, "x"), (1, b, "x"), (5, "", ""), (5, " ", "")])
    assert jaccard.one_of_each(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs.withColumn("doc_id", F.col("doc_id").cast("int")).where("doc_id = 1")).count() == 2


@pytest.mark.parametrize("whole", [True, False])
def test_groups_and_buckets_give_the_same_links(spark, whole, monkeypatch):
    """Chains of texts that share half their n-grams, cut into small tiles."""
    monkeypatch.setattr(jaccard, "BLOCK", 10**6 if whole else 8)
    rnd = random.Random(7)
    words = [rnd.choice("abcdefgh") * 2 + str(k) for k in range(600)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 520, 4)] + [" ".join(words[k : k + 60]) + " x" for k in range(0, 520, 8)]
    sets = [shingle_set(t) for t in texts]
    links, comp = brute_links(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    got = {r.doc_id: r for r in jaccard.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links and [got[i].component_id for i in range(len(texts))] == comp


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.9995), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = jaccard.bands_for(t, r, 200)
        assert 1 - (1 - t**rows) ** bands >= r and bands * rows <= 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (200, 200), (None, 3)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in (100, 101, 102)}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors(seed=1, n=300):
    rng = np.random.default_rng(seed)
    x = list(rng.normal(size=(n, 16)))
    x += [x[0] + rng.normal(scale=0.02, size=16) for _ in range(60)] + [x[1]] * 5 + [x[2] * 3]
    return [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, []]


def test_forest_recall_and_edges(spark):
    vs = vectors()
    d = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)] + [(None, vs[0], 1)], "vec_id long, embedding array<double>, codes int")
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vs]
    u = [np.array(v) / np.linalg.norm(v) if g else None for v, g in zip(vs, good, strict=True)]
    links, comp = brute_links(len(vs), lambda i, j: good[i] and good[j] and u[i] @ u[j] >= 0.9)
    got = {r.vec_id: r for r in rpforest.link_vectors(d, leaf=32).collect()}
    found = [got[i].n_links for i in range(len(vs))]
    assert sum(found) >= 0.9 * sum(links) and all(a <= b for a, b in zip(found, links, strict=True))
    assert [got[i].component_id for i in range(len(vs))] == comp and got[None].n_links == 0
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(vs)))
    assert rpforest.link_vectors(d.limit(0)).count() == 0
    exact = {r.vec_id: r.n_links for r in rpforest.link_vectors(d, leaf=10_000).collect()}
    assert [exact[i] for i in range(len(vs))] == links


def test_repeated_vector_ids_are_vectors_of_their_own(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.01]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rpforest.link_vectors(d).collect())
    assert got == [(1, 2, 1, True)] * 3 + [(2, 0, 2, True)] * 2


def test_code_bits():
    rng = np.random.default_rng(1)
    codes = [np.unique(rng.integers(0, 300, rng.integers(0, 9))) for _ in range(60)]
    bits = rpforest.code_bits(codes)
    for i in range(60):
        for j in range(60):
            if i != j:
                assert bool((bits[i] & bits[j]).any()) == bool(set(codes[i]) & set(codes[j]))
    assert not rpforest.code_bits([np.zeros(0, np.int64)] * 3).any()


def test_forest_recall_in_a_loose_large_group(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:2000] = np.sqrt(0.85) * x[-1] + np.sqrt(0.15) * x[:2000]  # mean pairwise cosine 0.85
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in rpforest.link_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), leaf=64).collect()}
    assert sum(got.values()) >= 0.98 * links.sum() > 0 and all(got[i] <= n for i, n in enumerate(links))


def test_forest_goes_deeper_than_its_sample():
    x = np.random.default_rng(2).normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = rpforest.build(x[:256], 4000, trees=1, leaf=16)[0]
    rows, codes = tree.place(x)
    assert set(rows) == set(range(4000)) and np.bincount(np.unique(codes, return_inverse=True)[1]).max() < 700


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vs = [rng.integers(-3, 4, 8).tolist() for _ in range(500)] + [[1] * 8] * 300 + [None, [], [float("inf")] * 8, [2.0] * 5]
    d = spark.createDataFrame([(i, None if v is None else [float(c) / 256 for c in v], "x") for i, v in enumerate(vs)] + [(None, [0.1] * 8, "x")], "vec_id long, embedding array<double>, score string")
    rows = d.select(F.col("vec_id").alias("id"), topk.quantised().alias("v"))
    got = {}
    for r in topk.top_k(rows.where("id % 50 = 0"), rows, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 800, 50):
        s = sorted((-int(np.dot(vs[q], vs[i])), i) for i in range(800) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert set(got) == set(range(0, 800, 50))
    assert topk.top_k(rows.limit(0), rows, 5).count() == 0


def test_top_k_keeps_rows_where_bins_pass_the_range(spark):
    rng = np.random.default_rng(6)
    columns = [[0, *np.linspace(101600, 101999, 100).astype(int), 102010, 102050, 102399]]
    for _ in range(39):  # a low score, a group that one bin holds, and 1 to 4 scores just above it
        top, width = rng.integers(60_000, 140_000), rng.integers(100, 500)
        columns.append([0, *rng.integers(top - width, top, 102 - (m := rng.integers(1, 5))), *rng.integers(top, top + width, m), top + width])
    scores = np.array(columns).T.astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(scores)], "id long, v array<double>")
    queries = spark.createDataFrame([(1000 + q, v.tolist()) for q, v in enumerate(np.eye(40))], "id long, v array<double>")
    got = {}
    for r in topk.top_k(queries, rows, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(40):
        s = sorted((-int(x), i) for i, x in enumerate(scores[:, q]))[:5]
        assert sorted(got[1000 + q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]


def test_top_k_of_repeated_ids(spark):
    rows = spark.createDataFrame([(0, [1.0]), (7, [3.0]), (7, [3.0]), (8, [2.0]), (0, [9.0])], "id long, v array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows.where("v = array(1.0D)"), rows, 3).collect())
    assert got == [(0, 1, 7, 3), (0, 2, 7, 3), (0, 3, 8, 2)]  # rows of the query's own id take no part


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, repeated ids of different texts, extra columns of clashing names; and tables without rows."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"node": F.lit(1), "bands": F.lit("x"), "spans": F.lit(None).cast("string"), "score": F.lit(0.5), "sequence_id": F.col("doc_id"), "__n": F.lit(2)})
    good = docs.join(labels.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi").orderBy(F.length("text").desc()).limit(2).collect()
    odd = [r.asDict() for r in good]
    odd = [odd[0] | {"doc_id": 900_001}, odd[1] | {"doc_id": 900_001, "text": odd[1]["text"][::-1][:10] + odd[1]["text"]}, odd[0] | {"doc_id": None}, odd[0] | {"doc_id": 900_002, "text": None}, odd[0] | {"doc_id": 900_003, "text": "", "lang": None, "source": None, "n_chars": None}]
    docs = docs.union(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in odd], docs.schema))
    docs.write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    labels.union(labels.limit(1).select(*[F.lit(None).cast(f.dataType) for f in labels.schema])).write.parquet(f"file://{tmp_path}/odd/labels.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, f"file://{tmp_path}/odd").collect(), docs.schema)
        assert now.columns == docs.columns and now.count() > 0
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}/odd")
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").distinct().collect()}
    docs.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"file://{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline_against_its_operators(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where("score >= 0.7").collect()}
    mild = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("score < 0.5").collect()}
    left = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in good & mild]
    sets = [shingle_set(r.text) for r in left]
    _, comp = brute_links(len(left), lambda i, j: bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    kept = [r for i, r in enumerate(left) if comp[i] == i]
    masked = secrets.without_secrets(spark.createDataFrame(kept, docs.schema)).collect()
    enc = packing.Encoder(packing.tokenizer_path())
    want = {r.doc_id: enc.encode(r.text) + (1).to_bytes(4, "little") for r in masked}
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        assert sorted(own) == [(s, n, zlib.crc32(want[i][4 * s : 4 * (s + n)])) for s, n, _ in sorted(own)] and sum(n for _, n, _ in own) * 4 == len(want[i])
    assert [s.columns for s in [corpus_pipeline.STAGES[k][1](spark, docs, sf) for k in (1, 3)]] == [docs.columns] * 2
