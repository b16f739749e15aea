"""Hard negatives by Fagin's threshold algorithm over shards of sorted lists.

Candidates are packed into shards of bounded size. A shard holds its integer vectors and, for each
dimension, a list of them sorted by that component. For an anchor, every list is read from the end that the
sign of the anchor's component favours, a stretch of all lists at a time; vectors that are met for the first time are
scored at random access. The components at which the lists stand bound the score of whatever hasn't been met:
that is the threshold. A window is closed once the threshold lies strictly below its kth score so far
(so that no tie is lost) or below the lowest score that it takes; the anchor is done with a shard when all its windows are.

Anchors meet shards in groups: a block of anchors, and a part of the shards. Within a group the kth
scores go on from shard to shard, so later ones are left earlier; groups give at most k rows for each window, and
the last step takes the first k of those. No pair of rows is emitted, no label or vector is a key of any shuffle, and
a hot label or a vector that is repeated costs what others do.

First pass: an anchor's positives are the rows of its label with the highest scores. Second pass: every
positive's score opens a window [low, high] of scores for rows of other labels.

Rows without id, label or vector, and vectors that are empty or hold null or non-finite components, take no
part. Vectors of another length are no candidates for an anchor. A repeated id: rows of the anchor's own id are not its positives;
an anchor id of several rows is mined for each of them. Exact while inner products stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import table, written
from tarmac.llm.topk import quantised

#: Bytes of a shard's vectors and its most rows, shards of a part, anchors of a block, first stretch of the lists.
SHARD, MOST, PART, ANCHORS, STRETCH = 1 << 20, 16_384, 32, 512, 32
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def shards(rows: DataFrame) -> DataFrame:
    """(dim, shard, ids, labels, vectors, lists) of rows (id long, label long, v array<double>), arrays as raw bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def shard(dim: int) -> pd.DataFrame:
            ids, labels, vectors = zip(*held.pop(dim), strict=True)
            x = np.array(vectors, np.float64)
            lists = np.argsort(x, 0, kind="stable").T.astype(np.int16)
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "labels": [np.array(labels, np.int64).tobytes()], "vectors": [x.tobytes()], "lists": [lists.tobytes()]})

        for pdf in batches:
            for r in zip(pdf.id, pdf.label, pdf.v, strict=True):
                dim = len(r[2])
                held.setdefault(dim, []).append(r)
                if len(held[dim]) >= min(MOST, max(1, SHARD // (8 * dim))):
                    yield shard(dim)
        for dim in list(held):
            yield shard(dim)

    return rows.mapInPandas(pack, "dim int, ids binary, labels binary, vectors binary, lists binary").select("*", F.monotonically_increasing_id().alias("shard"))


class Shard:
    """The candidates of one shard, with a sorted list for each dimension."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, vectors: bytes, lists: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x, self.lists = np.frombuffer(vectors, np.float64).reshape(-1, dim), np.frombuffer(lists, np.int16).reshape(dim, -1)

    def met(self, a: np.ndarray, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(rows met for the first time, their scores, threshold) of each stretch of the lists; the last threshold is minus infinity."""
        n = len(self.ids)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        if not len(up) + len(down):
            yield np.arange(n), np.zeros(n), -np.inf
            return
        seen, depth = np.zeros(n, bool), 0
        while depth < n:
            end = min(n, depth + stretch)
            now = np.zeros(n, bool)
            now[self.lists[up, n - end : n - depth]] = True  # the largest components first
            now[self.lists[down, depth:end]] = True
            rows = np.flatnonzero(now & ~seen)
            seen[rows] = True
            left = a[up] @ self.x[self.lists[up, n - end], up] + a[down] @ self.x[self.lists[down, end - 1], down]
            yield rows, self.x[rows] @ a, left if end < n else -np.inf
            depth, stretch = end, 2 * stretch


class Best:
    """The k best (score, id) of a window of scores, ties to the smaller id."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= max(self.low, self.scores[-1] if len(self.scores) == self.k else -np.inf)) & (scores <= self.high)
        if fits.any():
            s, i = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
            by = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[by], i[by]

    def closed(self, threshold: float) -> bool:
        return self.low > self.high or threshold < self.low or (len(self.scores) == self.k and threshold < self.scores[-1])


def search(anchor: np.ndarray, shard: Shard, fits: np.ndarray, windows: list[Best]) -> int:
    """Fills the windows from the rows of a shard that fit; returns how many rows were scored."""
    scored = 0
    for rows, scores, threshold in shard.met(anchor):
        scored += len(rows)
        ok = fits[rows]
        for w in windows:
            w.add(scores[ok], shard.ids[rows[ok]])
        if all(w.closed(threshold) for w in windows):
            break
    return scored


def _parts(anchors: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors and shards with the groups in which they meet: every block with every part of its length."""
    spark = anchors.sparkSession
    counts = {r.dim: r["count"] for r in packed.groupBy("dim").count().collect()}  # lengths of vectors
    blocks = {r.dim: -(-r["count"] // ANCHORS) for r in anchors.groupBy("dim").count().collect()}
    parallel = spark.sparkContext.defaultParallelism
    sizes = [(d, b, min(counts[d], max(-(-counts[d] // PART), -(-parallel // b)))) for d, b in blocks.items() if d in counts]
    sizes = F.broadcast(spark.createDataFrame(sizes, "dim int, blocks int, parts int"))  # a row for each length
    left = anchors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("n"), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = packed.join(sizes, "dim").withColumn("part", F.pmod(F.xxhash64("shard"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    return left.drop("blocks", "parts"), right.drop("blocks", "parts", "shard")


def _mined(anchors: DataFrame, packed: DataFrame, same: bool, k: int) -> DataFrame:
    """(n, w, id, score, rank): the k best rows of each window w of each anchor; anchors: (n, dim, id, label, v, windows array<struct<low, high>>).

    same: of the anchor's label, but not of its id; otherwise of other labels.
    """
    left, right = _parts(anchors, packed)

    def run(a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        open_ = [(r.n, r.id, r.label, np.array(r.v, float), [Best(k, w["low"], w["high"]) for w in r.windows]) for r in a.itertuples(index=False)]
        for x in s.itertuples(index=False):
            shard = Shard(x.dim, x.ids, x.labels, x.vectors, x.lists)
            for _, own, label, v, windows in open_:
                if windows:
                    search(v, shard, (shard.labels == label) & (shard.ids != own) if same else shard.labels != label, windows)
        out = [(n, j, i, sc) for n, _, _, _, windows in open_ for j, w in enumerate(windows) for i, sc in zip(w.ids.tolist(), w.scores.astype(np.int64).tolist(), strict=True)]
        return pd.DataFrame(out, columns=["n", "w", "id", "score"])

    found = left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part")).applyInPandas(run, "n long, w int, id long, score long")
    order = Window.partitionBy("n", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(anchors: DataFrame, candidates: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchors, candidates: (id long, label long, v array<double> of integers). Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    low, high: percentages of a positive's score between which its negatives lie.
    """
    usable = "id is not null and label is not null and v is not null"
    packed = written(shards(candidates.where(usable)), "shards")
    rows = written(anchors.where(usable).select(F.monotonically_increasing_id().alias("n"), F.size("v").alias("dim"), "id", "label", "v"), "anchors")
    window = "low double, high double"
    any_score = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    first = written(_mined(rows.withColumn("windows", any_score), packed, True, positives), "positives")
    bounds = F.struct(F.ceil(F.col("score") * low / 100).cast("double").alias("low"), F.floor(F.col("score") * high / 100).cast("double").alias("high"))
    # an anchor's positives are few; a window is empty where the score is negative
    lists = first.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", bounds.alias("b")))), lambda x: x["b"]).cast(f"array<struct<{window.replace(' double', ':double')}>>").alias("windows"))
    second = _mined(rows.join(lists, "n"), packed, False, negatives)
    known = first.select("n", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = rows.select("n", F.col("id").alias("anchor_id")).join(known, "n")
    return second.select("n", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["n", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negative_mining(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), quantised().alias("v"))
    return hard_negatives(rows.where("id % 100 = 0"), rows)


OP12_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS w FROM s WHERE same AND vec_id <> anchor_id QUALIFY w <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, w ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""
