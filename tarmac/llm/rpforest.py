"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

A tree splits by a random direction at the median, again and again; points near the split, SPILL of the
points on each side, go both ways. Upper splits are fitted on a bounded sample of SAMPLE vectors, the
ones with the smallest hash; below, when there are more vectors than the sample resolves,
directions go on at random, through the centre of the sample's leaf. A node whose sample is one clump (mean
cosine to its centre over TIGHT) isn't split. Deeper trees miss more, so their number follows from the depth.
Splits would part the pairs of a large loose group, so groups in which the sample shows links come first: a ball
around a group is a leaf of its own, as wide as the linked vectors of its core reach in the sample. A vector of a
core meets its links there and is placed in no tree; every other one is placed in every tree. Leaves are cut into
tiles of two blocks of at most BLOCK vectors, so a hot leaf is many tasks; a tile compares all its
pairs in double precision. A pair that meets in several leaves counts in the first of them, which
each side's list of leaves shows, so no pair is emitted: a tile returns numbers of links and a spanning
forest of its links.

Equal vectors are compared once, as one, and link with each other. Vectors that are null, empty, zero or
hold null or non-finite components link with nothing, nor do those of different lengths. Rows without
vec_id are left out of the comparison and returned without links. A repeated vec_id counts as another
vector in n_links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import table, written
from tarmac.llm.components import components
from tarmac.llm.jaccard import forest

THRESHOLD, TREES, LEAF, SPILL, SAMPLE, TIGHT, BLOCK, SEED = 0.9, 4, 512, 0.07, 8192, 0.95, 1024, 5
#: Cosine to the centre of a group's core; share of linked pairs in a ball from which it is compared as a whole; most balls.
CORE, LINKED, BALLS = 0.85, 0.00001, 256
#: Share of close pairs that one level of one tree keeps together, and what all trees are to keep.
LEVEL, RECALL = 0.953, 0.99


class Tree:
    """Splits of one tree: per node a direction and three cuts, or a leaf number."""

    def __init__(self, sample: np.ndarray, depth: int, extra: int, rng: np.random.Generator, spill: float):
        self.direction, self.cuts, self.child, self.leaf = [], [], [], []
        self.extra = rng.normal(size=(extra, sample.shape[1]))
        self.leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centre, low, high of the extra splits
        self._grow(sample, depth, rng, spill)

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator, spill: float) -> int:
        node = len(self.leaf)
        for column in (self.direction, self.cuts, self.child, self.leaf):
            column.append(None)
        centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
        if depth and len(x) >= 32 and np.linalg.norm(centre) <= TIGHT:
            d = rng.normal(size=x.shape[1])
            p = x @ d
            low, mid, high = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill])
            if low < high:
                self.direction[node], self.cuts[node] = d, (low, high)
                self.child[node] = (self._grow(x[p <= high], depth - 1, rng, spill), self._grow(x[p >= low], depth - 1, rng, spill))
                return node
        self.leaf[node] = len(self.leaves)
        tight = np.linalg.norm(centre) > TIGHT
        p = x @ self.extra.T if len(x) else np.zeros((1, len(self.extra)))
        mid, margin = np.median(p, 0), p.std(0) * 2.5 * spill
        self.leaves.append((mid - margin, mid + margin, np.array([not tight])))
        return node

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of each leaf that a row of x falls into."""
        rows, codes = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.leaf[node] is not None:
                r, c = self._deeper(x, at, self.leaf[node])
                rows.append(r)
                codes.append(c)
                continue
            p = x[at] @ self.direction[node]
            low, high = self.cuts[node]
            todo += [(self.child[node][0], at[p <= high]), (self.child[node][1], at[p >= low])]
        return np.concatenate(rows), np.concatenate(codes)

    def _deeper(self, x: np.ndarray, at: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        low, high, splits = self.leaves[leaf]
        code = np.full(len(at), leaf, np.int64)
        if splits[0]:
            for k, d in enumerate(self.extra):
                p = x[at] @ d
                left, right = p <= high[k], p >= low[k]
                at, code = np.concatenate([at[left], at[right]]), np.concatenate([code[left] * 2, code[right] * 2 + 1])
        else:
            code = code << len(self.extra)
        return at, code


class Balls:
    """Loose or tight large groups of a sample: centres, and the least cosines to them of cores and balls."""

    def __init__(self, sample: np.ndarray, n: int, leaf: int, threshold: float):
        self.centre, self.edge = np.zeros((0, sample.shape[1])), np.zeros(0)
        x = sample.astype(np.float32)
        least = max(16, leaf / 2 * len(x) / max(n, 1))  # smaller groups hardly meet a split
        if n <= leaf or len(x) < least:
            return
        near = np.concatenate([(x[a : a + 1024] @ x.T >= threshold - 0.1).sum(1) for a in range(0, len(x), 1024)])
        open_ = near >= least
        while open_.any() and len(self.edge) < BALLS:
            i = int(np.argmax(np.where(open_, near, 0)))
            open_[i] = False
            members = x @ x[i] >= threshold - 0.1
            for _ in range(5):
                c = x[members].mean(0)
                c /= np.linalg.norm(c)
                cos = x @ c
                members = cos >= CORE
                if not members.any():
                    break
            if members.sum() < least:
                continue
            core, reach = np.flatnonzero(members), []
            for a in range(0, len(core), 1024):
                part = core[a : a + 1024]
                linked = x[part] @ x.T >= threshold
                linked[np.arange(len(part)), part] = False
                reach.append(cos[np.nonzero(linked)[1]])
            reach = np.concatenate(reach)
            open_[members] = False
            if not len(reach):
                continue
            edge = min(CORE, float(np.quantile(reach, 0.002)) - 0.005)
            if len(reach) < LINKED * float((cos >= edge).sum()) * len(core):
                continue
            self.centre, self.edge = np.vstack([self.centre, c.astype(np.float64)]), np.append(self.edge, edge)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, ball) of each ball that a row of x falls into, and the rows that are in no core."""
        if not len(self.edge):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(x))
        cos = x @ self.centre.T
        rows, balls = np.nonzero(cos >= self.edge)
        return rows, balls, np.flatnonzero((cos < CORE).all(1))


def build(sample: np.ndarray, n: int, trees: int | None = None, leaf: int = LEAF, spill: float = SPILL) -> list[Tree]:
    """Trees for n vectors from unit vectors of a sample; without a number of trees, as many as RECALL takes."""
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    if trees is None:
        trees = max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - LEVEL**depth)))) if depth else TREES
    upper = min(depth, max(0, int(np.log2(max(len(sample), 1) / 32))))
    rngs = np.random.default_rng(SEED).spawn(trees)
    return [Tree(sample, upper, depth - upper, rng, spill) for rng in rngs]


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
    big = np.abs(x).max(1, keepdims=True)
    x = x / big  # so that neither tiny nor huge components spoil the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v) with v the components as doubles; v is null for a vector that can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                raw.append((x + 0.0).tobytes() if good else None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dim", "v"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v binary")


def _grown(sample: np.ndarray, n: int, trees: int | None, leaf: int, spill: float, threshold: float) -> tuple[Balls, list[Tree]]:
    balls = Balls(sample, n, leaf, threshold)
    rest = sample[balls.place(sample)[2]]
    return balls, build(rest, int(np.ceil(n * len(rest) / len(sample))), trees, leaf, spill)


def _codes(balls: Balls, trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each leaf of a row of x, balls being numbered after the trees."""
    row, ball, rest = balls.place(x)
    rows, codes = [row], [ball + (len(trees) << 56)]
    for t, tree in enumerate(trees if len(rest) else []):
        r, c = tree.place(x[rest])
        rows.append(rest[r])
        codes.append(c + (t << 56))
    return np.concatenate(rows), np.concatenate(codes)


def _placed(nodes: DataFrame, forests: dict[int, tuple[Balls, list[Tree]]]) -> DataFrame:
    held = nodes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = _unit(part.v.tolist(), int(dim))
                rows, codes = _codes(*held.value[int(dim)], x)
                by = np.lexsort((codes, rows))
                cut = np.searchsorted(rows[by], np.arange(1, len(x)))
                yield part.assign(codes=np.split(codes[by], cut))

    return nodes.mapInPandas(run, "node long, dim int, v binary, copies long, codes array<long>")


def code_bits(codes: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each list of codes: two lists have a code in common where their rows have a bit in common."""
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    _, col, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    shared = n[col] > 1  # a code of one list alone is in common with none
    row, col = row[shared], (np.cumsum(n > 1) - 1)[col[shared]]
    out = np.zeros((len(codes), 8 * (int(col.max(initial=-1)) // 64 + 1)), np.uint8)
    np.bitwise_or.at(out, (row, col // 8), (1 << (col % 8)).astype(np.uint8))
    return out.view(np.uint64)


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf.v.tolist(), int(pdf.dim.iloc[0]))
        node, copies, block = pdf.node.to_numpy(), pdf.copies.to_numpy(), pdf.block.to_numpy()
        a, b = pdf.a.iloc[0], pdf.b.iloc[0]
        earlier = code_bits([np.asarray(c, np.int64) for c in pdf.codes])
        links, top = np.zeros(len(x), np.int64), []
        left, right = (np.flatnonzero(block == s) for s in (a, b))
        for s in range(0, len(left), 256):
            i, j = np.nonzero(x[left[s : s + 256]] @ x[right].T >= threshold)
            i, j = left[s : s + 256][i], right[j]
            if a == b:
                i, j = i[i < j], j[i < j]
            mine = np.ones(len(i), bool)  # pairs that meet in no earlier leaf
            for c in range(0, len(i), 1 << 16):
                mine[c : c + 65536] = ~(earlier[i[c : c + 65536]] & earlier[j[c : c + 65536]]).any(1)
            i, j = i[mine], j[mine]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            top += forest(i, j, len(x))
        if top:
            i, j = np.array(top).T
            top = forest(i, j, len(x))
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": np.concatenate([node[some], node[[e[0] for e in top]]]).astype(np.int64), "other": pd.array([None] * len(some) + [node[e[1]] for e in top], "Int64"), "links": np.concatenate([links[some], np.zeros(len(top), np.int64)])})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int | None = None, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding)."""
    rows = written(_packed(vectors.select(F.col("vec_id").cast("long"), "embedding")), "vectors")
    usable = rows.where("v is not null and vec_id is not null")
    distinct = usable.groupBy("dim", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = written(distinct.select(F.monotonically_increasing_id().alias("node"), "dim", "v", "copies", "vec_id"), "distinct-vectors")
    forests = {}
    for dim, n in nodes.groupBy("dim").count().collect():
        share = min(1.0, 2.0 * SAMPLE / n + 0.001)  # what can't be among the first SAMPLE stays in the tasks
        head = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= int(share * (1 << 20))
        sample = [r.v for r in nodes.where((F.col("dim") == dim) & head).select("v").orderBy(F.pmod(F.xxhash64("v"), F.lit(1 << 20)), F.xxhash64("v"), "v").limit(SAMPLE).collect()]
        forests[dim] = _grown(_unit([bytes(v) for v in sample], dim), n, trees, leaf, spill, threshold)
    if not forests:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = written(_placed(nodes.drop("vec_id"), forests), "placed")
    # of its list of leaves, a row takes along the ones before the leaf
    member = placed.withColumn("code", F.explode("codes")).withColumn("codes", F.filter("codes", lambda c: c < F.col("code")))
    sizes = placed.select("dim", F.explode("codes").alias("code")).groupBy("dim", "code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = member.join(sizes, ["dim", "code"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("a", F.least("block", "o")).withColumn("b", F.greatest("block", "o")).drop("o", "blocks")
    found = written(tiles.groupBy("dim", "code", "a", "b").applyInPandas(_compare(threshold), "node long, other long, links long"), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst"))).select(F.col("id").alias("node"), F.col("component_id").alias("root"))
    first = linked.join(nodes.select("node", "vec_id"), "node").groupBy("root").agg(F.min("vec_id").alias("first"))
    linked = linked.join(first, "root").select("node", "first")
    result = nodes.join(counts, "node", "left").join(linked, "node", "left").select("dim", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    out = rows.join(result, ["dim", "v"], "left")
    usable = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    own = F.when(usable, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(usable, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
