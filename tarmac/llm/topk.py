"""Exact top-k search by integer inner product, through global score histograms.

Every query is scored against every candidate, in blocks: packed blocks of candidates meet packed
blocks of queries in an equi-join on the query block, so neither side is broadcast or collected, and
no pair of rows is ever emitted. A round counts, for each query, how many scores fall into each bin
of its current range; the counts of all tasks are added up and locate the bin of the kth score, which
is the next range. Ranges start at the extremes of all scores and shrink by the number of bins, until
the kth score is exact or its bin and those above hold few scores. The last pass filters by that bound; of the
scores that tie, a block passes on those of the k smallest ids, which is all that can be chosen.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id. Repeated ids are candidates of their own, except to the query of the same id; a query id that
occurs more than once is searched once for each row and ranks all rows together. Vectors of another
length than a query's are no candidates for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import table, written

BLOCK, BINS, FEW = 4096, 256, 64


def quantised(vec: str = "embedding", levels: int = 256) -> Column:
    """floor(levels * x) of each component, or null for a vector that takes no part."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * levels).cast("double")))


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Blocks of rows (id, v) of one length: (dim, block, ids, matrix) as raw bytes, one per row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            part = held.pop(dim)
            return pd.DataFrame({"dim": [dim], f"{name}_ids": [np.array([i for i, _ in part], np.int64).tobytes()], name: [np.array([v for _, v in part], np.float64).tobytes()]})

        for pdf in batches:
            for i, v in zip(pdf.id, pdf.v, strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == BLOCK:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.mapInPandas(pack, f"dim int, {name}_ids binary, {name} binary")


def _scores(r, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries and candidates, and scores; minus infinity for a query's own row."""
    q, c = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.c_ids, np.int64)
    s = np.frombuffer(r.q, np.float64).reshape(len(q), dim) @ np.frombuffer(r.c, np.float64).reshape(len(c), dim).T
    own = np.flatnonzero(np.isin(q, c))
    for i in own:
        s[i, c == q[i]] = -np.inf
    return q, c, s


def _pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each query block with each candidate block of its length."""
    blocks = queries.select("dim", F.monotonically_increasing_id().alias("block"), "q_ids", "q")
    blocks = written(blocks, "query-blocks")
    per = blocks.groupBy("dim").agg(F.collect_list("block").alias("blocks"))  # numbers of blocks only
    return candidates.join(per, "dim").withColumn("block", F.explode("blocks")).drop("blocks").join(blocks, ["dim", "block"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """queries and candidates: (id long, v array<double>). Returns query_id, rank, vec_id, score.

    Exact while inner products stay below 2**53. Fewer than k candidates: all of them.
    """
    sides = [_packed(d.where("id is not null and v is not null"), n) for d, n in ((queries, "q"), (candidates, "c"))]
    pairs = _pairs(sides[0], written(sides[1], "candidate-blocks").repartition(candidates.sparkSession.sparkContext.defaultParallelism))

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q, _, s = _scores(r, r.dim)
                low = np.where(np.isinf(s), np.inf, s).min(1)
                yield pd.DataFrame({"block": r.block, "n": np.arange(len(q)), "lo": low, "hi": s.max(1)})[lambda d: d.hi > -np.inf]

    state = written(pairs.mapInPandas(extremes, "block long, n long, lo double, hi double").groupBy("block", "n").agg(F.min("lo").cast("long").alias("lo"), (F.max("hi") + 1).cast("long").alias("hi")).withColumns({"above": F.lit(0).cast("long"), "done": F.lit(False)}), "ranges")
    while not state.where("not done").isEmpty():
        state = written(_refined(pairs, state, k), "ranges")

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q, c, s = _scores(r, r.dim)
                bound = np.full(len(q), np.inf)
                bound[np.frombuffer(r.n, np.int64)] = np.frombuffer(r.lo, np.int64)
                i, j = np.nonzero(s >= bound[:, None])
                v = s[i, j]
                by = np.lexsort((c[j], -v, i))
                i, j, v = i[by], j[by], v[by]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                yield pd.DataFrame({"block": r.block, "n": i[keep], "query_id": q[i[keep]], "vec_id": c[j[keep]], "score": v[keep].astype(np.int64)})

    found = _with_state(pairs, state).mapInPandas(final, "block long, n long, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_state(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs of blocks with the ranges of the query block, at most BLOCK of them, packed."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])]} | {c: [pdf[c].to_numpy(np.int64).tobytes()] for c in ("n", "lo", "hi")})

    packed = written(state.groupBy("block").applyInPandas(pack, "block long, n binary, lo binary, hi binary"), "packed-ranges")
    return pairs.join(packed, "block")


def _refined(pairs: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """One round: the bin that holds the kth score becomes the range."""
    todo = state.where("not done")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        ns: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                n, lo, hi = (np.frombuffer(x, np.int64) for x in (r.n, r.lo, r.hi))
                _, _, s = _scores(r, r.dim)
                width = np.maximum(1, -(-(hi - lo) // BINS))
                h = sums.setdefault(r.block, np.zeros((len(n), BINS), np.int64))
                ns[r.block] = n
                for a in range(0, len(n), 256):  # a few queries at a time bound what is held
                    b = np.floor((s[n[a : a + 256]] - lo[a : a + 256, None]) / width[a : a + 256, None])
                    i, j = np.nonzero((b >= 0) & (s[n[a : a + 256]] < hi[a : a + 256, None]))  # bins may pass hi; `above` holds what lies there
                    h[a : a + 256] += np.bincount(i * BINS + b[i, j].astype(np.int64), minlength=len(b) * BINS).reshape(len(b), BINS)
        for block, h in sums.items():
            yield pd.DataFrame({"block": block, "n": ns[block], "h": list(h)})

    parts = _with_state(pairs, todo).mapInPandas(count, "block long, n long, h array<long>")
    total = parts.groupBy("block", "n").agg(F.array(*[F.sum(F.col("h")[i]) for i in range(BINS)]).alias("h"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / BINS))
    at_least = F.aggregate(F.sequence(F.lit(BINS - 1), F.lit(0), F.lit(-1)), F.struct(F.lit(-1).alias("bin"), F.col("above").alias("above"), F.lit(0).cast("long").alias("here")), lambda a, b: F.when(a["bin"] >= 0, a).when(a["above"] + F.col("h")[b] >= k, F.struct(b.alias("bin"), a["above"].alias("above"), F.col("h")[b].alias("here"))).otherwise(F.struct(F.lit(-1).alias("bin"), (a["above"] + F.col("h")[b]).alias("above"), F.lit(0).cast("long").alias("here"))))
    new = todo.join(total, ["block", "n"]).withColumn("w", width).withColumn("a", at_least)
    lo = F.when(F.col("a.bin") >= 0, F.col("lo") + F.col("a.bin") * F.col("w")).otherwise(F.col("lo")).cast("long")
    new = new.select("block", "n", lo.alias("lo"), (F.when(F.col("a.bin") >= 0, F.least(lo + F.col("w"), F.col("hi"))).otherwise(F.col("hi"))).cast("long").alias("hi"), F.col("a.above").alias("above"), ((F.col("a.bin") < 0) | (F.col("w") == 1) | (F.col("a.above") + F.col("a.here") <= FEW)).alias("done"))
    return new.union(state.where("done").select(*new.columns))


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised().alias("v"))
    return top_k(rows.where("id % 50 = 0"), rows, 5)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
