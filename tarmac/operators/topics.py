"""Document-term tables and topic models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.order import cumulative
from tarmac.sources.stages import remove, stage_path, staged

#: Most terms of a broadcast list; tokens times topics of documents that go on side by side; terms in a row of counts.
MOST_TERMS, DRAWS, TERMS_AT_ONCE = 200_000, 2_000_000, 4096


def dtm(df: DataFrame, text: str, key: str = "doc_id", min_docs: int = 5, min_len: int = 3) -> DataFrame:
    """(doc_id, term, tf) of terms in at least min_docs documents. Texts are cut once; their counts are written.

    Terms are counted inside their row, so a task holds one text, and pairs of document and term don't move: only ids that stand on several rows
    have theirs added up, and only terms beyond the MOST_TERMS most frequent are looked up by a shuffle.
    """
    words = F.sort_array(F.filter(F.split(text, r"\s+"), lambda x: F.length(x) >= min_len))
    rows = df.select(F.col(key).alias("doc_id"), words.alias("w")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(~x.eqNullSafe(F.get("w", i - 1)), i)), F.isnotnull))  # where each term begins
    each = F.transform("at", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("w")) - i).cast("long").alias("tf")))
    rows = staged(rows.select("doc_id", "row", F.inline(each)), "term-counts")
    counts = _added_up(rows)
    often = staged(counts.groupBy("term").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs), "frequent-terms")
    if often.count() <= MOST_TERMS:
        return counts.join(F.broadcast(often), "term", "left_semi").select("doc_id", "term", "tf")
    top = F.broadcast(often.orderBy(F.desc("docs"), "term").limit(MOST_TERMS))
    rest = counts.join(top, "term", "left_anti").join(often, "term", "left_semi")
    return counts.join(top, "term", "left_semi").unionByName(rest).select("doc_id", "term", "tf")


def _added_up(rows: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of counts by row: those of an id with several rows are summed, all others stay where they are."""
    several = staged(rows.groupBy("doc_id").agg((F.min("row") < F.max("row")).alias("several")).where("several").select("doc_id"), "ids-of-several-rows")
    counts = rows.drop("row")
    if several.isEmpty():
        return counts
    same = counts["doc_id"].eqNullSafe(several["doc_id"])
    sums = counts.join(several, same, "left_semi").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return staged(counts.join(several, same, "left_anti").unionByName(sums), "term-counts")


def _numbered(counts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(term, i) with the most frequent terms first, counts with i, and the number of terms."""
    known = counts.groupBy("term").agg(F.sum("tf").alias("n")).select("term", (-F.col("n")).alias("less"), F.lit(1).alias("one"))
    vocab = staged(cumulative(known, ["less", "term"], "one", "i").select("term", (F.col("i") - 1).cast("int").alias("i")), "vocabulary")
    size, often = vocab.count(), F.broadcast(vocab.where(F.col("i") < MOST_TERMS))
    pairs = counts.join(often, "term")
    if size > MOST_TERMS:
        pairs = pairs.unionByName(counts.join(often, "term", "left_anti").join(vocab, "term"))
    return vocab, pairs, size


def _vectors(counts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Sparse count vectors of all terms, written, since every round of a model reads them, and the vocabulary, the most frequent terms first."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    vocab, pairs, size = _numbered(counts)
    vector = F.udf(lambda i, n: Vectors.sparse(size, i, n), VectorUDT())
    docs = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", F.col("tf").cast("double").alias("tf")))).alias("x"))
    return staged(docs.select("doc_id", vector("x.i", "x.tf").alias("features")), "term-vectors"), [r.term for r in vocab.orderBy("i").collect()]


def _fitted(vectors: DataFrame, k: int, iters: int, seed: int, **how):
    """Each iteration draws as many documents as there are, so its step is that of a whole corpus and early ones count fully."""
    from pyspark.ml.clustering import LDA

    return LDA(k=k, maxIter=iters, seed=seed, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, **how).fit(vectors)


def lda(counts: DataFrame, k: int, alpha: float = 0.2, iters: int = 50, seed: int = 42):
    """A variational topic model of all terms: (model, vectors, vocabulary)."""
    vectors, vocab = _vectors(counts)
    return _fitted(vectors, k, iters, seed, docConcentration=[alpha] * k), vectors, vocab


def topic_terms(model, vocab: list[str], spark, n: int = 15) -> DataFrame:
    """(topic, rank, term, weight): the n heaviest terms of each topic."""
    rows = [(t.topic, r + 1, vocab[i], float(w)) for t in model.describeTopics(n).collect() for r, (i, w) in enumerate(zip(t.termIndices, t.termWeights, strict=True))]
    return spark.createDataFrame(rows, "topic int, rank int, term string, weight double")


def topic_names(terms: DataFrame, n: int = 5) -> DataFrame:
    return terms.where(F.col("rank") <= n).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("name"))


def doc_topics(model, vectors: DataFrame, texts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, topic, share, and the text columns), of chosen ids if given."""
    from pyspark.ml.functions import vector_to_array

    if ids is not None:
        vectors = vectors.join(ids, "doc_id", "left_semi")
    shares = model.transform(vectors).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))
    return shares.join(texts, "doc_id")


def main_topic(model, vectors: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    d = model.transform(vectors).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("share"), "topic"))).where("r = 1").drop("r")


def topic_scan(counts: DataFrame, ks: list[int], iters: int = 50, seed: int = 42) -> DataFrame:
    """(k, mean_cosine, mean_divergence) of the topics of each k over all terms: similar topics are too many."""
    vectors, _ = _vectors(counts)
    rows = []
    for k in ks:
        t = _fitted(vectors, k, iters, seed).topicsMatrix().toArray().T
        p = t / t.sum(1, keepdims=True)
        u = p / np.linalg.norm(p, axis=1, keepdims=True)
        i, j = np.triu_indices(k, 1)
        m = (p[i] + p[j]) / 2
        kl = lambda a, b: (a * np.log(np.maximum(a, 1e-300) / np.maximum(b, 1e-300))).sum(1)
        rows.append((k, float((u[i] * u[j]).sum(1).mean()), float((kl(p[i], m) + kl(p[j], m)).mean() / 2)))
    return counts.sparkSession.createDataFrame(rows, "k int, mean_cosine double, mean_divergence double")


# topics by Gibbs sampling


@dataclass
class GibbsTopics:
    """What a sampler left: tokens with their topics, and counts of terms by topic."""

    state: DataFrame  # (doc_id, terms array<int>, z array<int>)
    vocab: DataFrame  # (term, i), the most frequent terms first
    counts: np.ndarray  # (terms, topics)
    alpha: float
    delta: float

    def terms(self, n: int = 15) -> DataFrame:
        """(topic, rank, term, weight): the n heaviest terms of each topic, ties in the order of the vocabulary."""
        p = (self.counts + self.delta) / (self.counts.sum(0) + len(self.counts) * self.delta)
        rows = [(k, r + 1, int(i), float(p[i, k])) for k in range(p.shape[1]) for r, i in enumerate(np.argsort(-p[:, k], kind="stable")[:n])]
        heaviest = self.state.sparkSession.createDataFrame(rows, "topic int, rank int, i int, weight double")
        return self.vocab.join(F.broadcast(heaviest), "i").select("topic", "rank", "term", "weight")

    def shares(self) -> DataFrame:
        """(doc_id, topic, share) of every document with terms."""
        k = self.counts.shape[1]
        n = [F.size(F.filter("z", _is(i))) for i in range(k)]
        share = F.array(*[(x + self.alpha) / (F.size("z") + k * self.alpha) for x in n])
        return self.state.select("doc_id", F.posexplode(share).alias("topic", "share"))


def _is(i: int):
    return lambda z: z == i


def gibbs_lda(counts: DataFrame, k: int, alpha: float = 0.2, delta: float = 0.1, sweeps: int = 500, seed: int = 67) -> GibbsTopics:
    """A topic model of (doc_id, term, tf) by collapsed Gibbs sampling, distributed over documents.

    In a sweep every document draws a topic for each of its tokens in turn: from its own counts, which follow each draw, and from the
    counts of terms by topic as the sweep before left them, without the token itself. Then the counts are added up anew. So documents don't depend
    on each other within a sweep, and with draws that follow from seed, sweep and document the result is the same for
    any partitioning. The table of counts (terms times topics, 8 bytes each) is all that the driver and the workers hold; the vocabulary stays
    in Spark, and tokens are written after each sweep, and those of the sweep before go.
    """
    spark = counts.sparkSession
    vocab, pairs, size = _numbered(counts)
    tokens = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("tf").cast("int").alias("tf")))), lambda x: F.array_repeat(x["i"], x["tf"])))
    docs = pairs.groupBy("doc_id").agg(tokens.alias("terms"))
    kind = dict(docs.dtypes)["doc_id"]

    def swept(rows: DataFrame, sweep: int, table: np.ndarray | None) -> DataFrame:
        held = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in _parts(whole.terms.map(len).to_numpy(), DRAWS // k):
                    pdf = whole.iloc[at]
                    draws = _uniform(pdf.h.to_numpy(), pdf.terms.map(len).to_numpy(), seed * 1_000_003 + sweep)
                    z = [(u * k).astype(np.int32) for u in draws] if held.value is None else _drawn(list(pdf.terms), list(pdf.z), draws, held.value, alpha, delta)
                    yield pd.DataFrame({"doc_id": pdf.doc_id.to_numpy(), "terms": pdf.terms.to_numpy(), "z": z})

        return rows.withColumn("h", F.xxhash64("doc_id")).mapInPandas(run, f"doc_id {kind}, terms array<int>, z array<int>")

    def counted(rows: DataFrame) -> np.ndarray:
        """Counts of terms by topic; a task sums its own, and parts of the table are added up."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(size * k, np.int64)
            for batch in batches:
                cells = batch.column("terms").flatten().to_numpy().astype(np.int64) * k + batch.column("z").flatten().to_numpy()
                for at in range(0, len(cells), DRAWS):
                    np.add.at(table, cells[at : at + DRAWS], 1)
            for at in range(0, len(table), TERMS_AT_ONCE * k):
                yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int64()), "n": pa.array([table[at : at + TERMS_AT_ONCE * k]], pa.list_(pa.int64()))})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "n": [np.sum(np.stack(pdf.n.tolist()), 0)]})

        parts = rows.select("terms", "z").mapInArrow(run, "part long, n array<long>").groupBy("part").applyInPandas(added, "part long, n array<long>").collect()
        return np.concatenate([np.zeros(0), *[r.n for r in sorted(parts, key=lambda r: r.part)]]).reshape(-1, k)

    state, before = docs, None
    for sweep in range(sweeps + 1):  # the first one deals topics out
        path = stage_path(spark, "gibbs")
        swept(state, sweep, counted(state) if sweep else None).write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return GibbsTopics(state, vocab, counted(state), alpha, delta)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(h: np.ndarray, size: np.ndarray, key: int) -> list[np.ndarray]:
    """size[i] numbers from 0 to 1 that follow from h[i] and key, by SplitMix64."""
    start = _mixed(h.astype(np.int64).view(np.uint64) ^ _mixed(np.array([key], np.uint64)))
    ends = np.cumsum(size)
    place = np.arange(1, size.sum() + 1, dtype=np.uint64) - np.repeat((ends - size).astype(np.uint64), size)
    u = (_mixed(np.repeat(start, size) + place * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
    return np.split(u, ends[:-1])


def _parts(size: np.ndarray, tokens: int) -> list[np.ndarray]:
    """Places of documents in groups of about `tokens` tokens, long documents together, so that a batch of any texts takes little memory."""
    order = np.argsort(-size, kind="stable")
    group = (np.cumsum(size[order]) - size[order]) // max(1, tokens)
    return np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []


def _drawn(terms: list[np.ndarray], z: list[np.ndarray], draws: list[np.ndarray], table: np.ndarray, alpha: float, delta: float) -> list[np.ndarray]:
    """New topics of the tokens of some documents: the documents go on side by side, each token after the one before it."""
    k, size = table.shape[1], np.array([len(t) for t in terms], int)
    order = np.argsort(-size, kind="stable")  # those that still have tokens come first
    doc, start = np.repeat(np.arange(len(order)), size[order]), np.concatenate(([0], np.cumsum(size[order])))[:-1]
    place = np.arange(len(doc)) - start[doc]
    by = np.argsort(place, kind="stable")  # first tokens of all documents, then their second ones, ...
    w, was, u = (np.concatenate([x[i] for i in order])[by] if len(order) else np.zeros(0) for x in (terms, z, draws))
    w, was, every = w.astype(np.int64), was.astype(np.int64), np.arange(len(by))
    own = np.bincount(was * len(order) + doc[by], minlength=k * len(order)).reshape(k, -1) + alpha
    # shares of each token's term in the topics, without the token itself
    total = table.sum(0) + len(table) * delta
    share = np.stack([((table[:, j] + delta) / total[j])[w] for j in range(k)])
    share[was, every] = (table[w, was] - 1 + delta) / (total[was] - 1)
    now, end = np.empty(len(by), np.int64), np.cumsum(np.bincount(place, minlength=1))
    for a, b in zip(np.concatenate(([0], end[:-1])).tolist(), end.tolist(), strict=True):
        rows = every[: b - a]
        own[was[a:b], rows] -= 1
        p = own[:, : b - a] * share[:, a:b]
        for j in range(1, k):
            p[j] += p[j - 1]
        cut = u[a:b] * p[-1]
        new = np.zeros(b - a, np.int64)
        for j in range(k - 1):
            new += p[j] <= cut
        own[new, rows] += 1
        now[a:b] = new
    back = np.empty(len(by), np.int32)
    back[by] = now
    out: list = [None] * len(order)
    for j, i in enumerate(order):
        out[i] = back[start[j] : start[j] + size[i]]
    return out
