"""Clustering around centroids with n-simplex projection, all distances that count being exact integers.

A few pivots span a simplex. The distances of a vector to all pivots are measured once, exactly, and turned
into the coordinates of an apex over that simplex, which stay with the vector: the last coordinate is its
height above the pivots' flat. Between two apexes, the distance with heights on the same side is never above
the true distance, that with heights on opposite sides never below it. So in each round a centroid whose
lower bound is above the smallest upper bound is out without a look at the vector; what is left is compared
by exact integer distance.

Rounding: bounds are doubles, so they are widened by more than their error, and pivots that lie almost in the
flat of the others are passed over. A pivot set of one point, as of equal vectors, gives the triangle inequality.

Vectors are integer and of one length, with squared distances below 2**63. A repeated vec_id is a vector of
its own. Of centroids at equal distance the smaller number counts. Fewer vectors than centroids: as many
centroids; no vectors: no rows. A round reads all vectors once and returns sums per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import table, written
from tarmac.llm.topk import quantised

PIVOTS, FLAT = 8, 0.05
CENTROIDS, ROUNDS, LENGTH, LEVELS, SEED = 16, 3, 64, 64, 1


def squared(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of p) of integer vectors."""
    return np.stack([((x - c) ** 2).sum(1) for c in p], 1) if len(p) else np.zeros((len(x), 0), np.int64)


class Simplex:
    """Pivots, and what turns squared distances to them into an apex."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        """Pivots are chosen of `points`: the first, then the one highest above the flat of those before."""
        self.pivots = points[:1]
        self.base = np.zeros((0, 0))  # coordinates of the pivots but the first, a lower triangle
        while len(self.pivots) < most:
            heights = self.apex(squared(points, self.pivots))
            i = int(heights[:, -1].argmax())
            row = heights[i]
            if row[-1] <= FLAT * max(1.0, np.sqrt((row**2).sum())) or len(self.pivots) > points.shape[1]:
                break
            self.base = np.vstack([np.hstack([self.base, np.zeros((len(self.base), 1))]), row])
            self.pivots = np.vstack([self.pivots, points[i]])

    def apex(self, d2: np.ndarray) -> np.ndarray:
        """(n, pivots): places in the flat of the pivots, then the height above it."""
        d2 = d2.astype(float)
        flat = np.linalg.solve(self.base, ((d2[:, :1] - d2[:, 1:] + (self.base**2).sum(1)) / 2).T).T if len(self.base) else d2[:, :0]
        return np.column_stack([flat, np.sqrt(np.maximum(d2[:, 0] - (flat**2).sum(1), 0))])

    def slack(self, apex: np.ndarray) -> np.ndarray:
        """More than the error of an apex: that of the solution, and of a height whose square is a difference."""
        far = np.sqrt((apex**2).sum(1))
        inverse = np.linalg.norm(np.linalg.inv(self.base), 2) if len(self.base) else 0.0
        return 1e-6 * (1 + far) + 1e-13 * inverse * far**2


def bounds(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between the vectors of two sets of apexes."""
    flat = np.zeros((len(a), len(c)))
    for j in range(a.shape[1] - 1):
        flat += (a[:, None, j] - c[None, :, j]) ** 2
    low, high = (flat + (a[:, None, -1] + sign * c[None, :, -1]) ** 2 for sign in (-1, 1))
    return np.sqrt(low), np.sqrt(high)


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each row of x, and how many exact distances it took."""
    at = simplex.apex(squared(centroids, simplex.pivots))
    low, high = bounds(apex, at)
    slack = 2 * (simplex.slack(apex)[:, None] + simplex.slack(at)[None, :])
    open_ = low - slack <= (high + slack).min(1)[:, None]
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for j, c in enumerate(centroids):
        i = np.flatnonzero(open_[:, j])
        d = ((x[i] - c) ** 2).sum(1)
        less = d < best[i]
        best[i[less]], cluster[i[less]] = d[less], j
    return cluster, best, int(open_.sum())


def _matrix(column: pa.ListArray, n: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def with_apexes(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """(vec_id, v, apex) of rows (vec_id, v array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apex = simplex.apex(squared(_matrix(b.column(1), b.num_rows, np.int64), simplex.pivots))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(apex), pa.list_(pa.float64()))], ["vec_id", "v", "apex"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, apex array<double>")


def assigned(rows: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """(vec_id, cluster, distance) of rows (vec_id, v, apex)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, d, _ = nearest(_matrix(b.column(1), b.num_rows, np.int64), _matrix(b.column(2), b.num_rows, float), centroids, simplex)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Centroids after one round: exact floors of the means; those without vectors stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), b.num_rows, np.int64)
                cluster, _, _ = nearest(x, _matrix(b.column(2), b.num_rows, float), centroids, simplex)
                n += np.bincount(cluster, minlength=k)
                for j in np.unique(cluster):
                    sums[j] += x[cluster == j].sum(0)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    new = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")).where("n > 0").collect():  # k rows
        new[r.cluster] = [s // r.n for s in r.sums]
    return new


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest hash, in its order; of one id, in the order of their components."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").where("h is not null").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of rows (vec_id long, v array<long>) after `rounds` moves, and the centroids."""
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    simplex = Simplex(centroids, pivots)
    rows = written(with_apexes(rows, simplex), "apexes")
    for _ in range(rounds):
        centroids = moved(rows, centroids, simplex)
    return written(assigned(rows, centroids, simplex), "assigned"), centroids


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == LENGTH)
    rows = rows.select(F.col("vec_id").cast("long"), F.transform(quantised(levels=LEVELS), lambda x: x.cast("long")).alias("v")).where("v is not null")
    found, centroids = cluster(rows)
    names = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = sums.join(names, "cluster").crossJoin(sums.agg(F.sum("cluster_inertia").alias("inertia")))  # a row for each centroid
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql() -> str:
    """The same rounds spelled out."""
    d2 = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, min({{'d': d, 'j': j}}) AS m FROM (SELECT r, vec_id, j, {d2} AS d FROM v, c{i} c) GROUP BY r)"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({LEVELS} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS j, e FROM (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS):
        parts += [
            near(i),
            f"""m{i} AS (SELECT j, list(x ORDER BY k) AS e FROM (SELECT j, k, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM
  (SELECT m.j AS j, k, sum(e[k]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {LENGTH + 1}) g(k) GROUP BY ALL)) GROUP BY j)""",
            f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (j))",
        ]
    return (
        "WITH "
        + ",\n".join([*parts, near(ROUNDS)])
        + f"""
SELECT a.vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.j = a.m.j"""
    )


OP13_SQL = _op13_sql()
