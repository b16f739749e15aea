"""Nearest neighbours among all rows, and mixed distances to short lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.sources.stages import staged

#: Sampled points that the cells are cut from, points wanted in a cell, most points that a task compares at once.
SAMPLE, CELL, BLOCK = 65_536, 4096, 16_384


def standardised(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Complete rows of (key, cols) with columns as z-scores; constant columns are 0."""
    d = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    m = d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])
    return d.crossJoin(F.broadcast(m)).select(key, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in cols])


class Cells:
    """Boxes from cutting a sample at the median of its widest column, again and again; they fill the space."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.child, self.n = [], [], [], 0
        self._grow(sample, cells)

    def _grow(self, x: np.ndarray, cells: int) -> int:
        node = len(self.axis)
        for column in (self.axis, self.cut, self.child):
            column.append(None)
        if cells > 1 and len(x) > 8:
            axis = int(np.argmax(np.ptp(x, axis=0)))
            cut = float(np.median(x[:, axis]))
            left = x[:, axis] <= cut
            if not left.all():
                self.axis[node], self.cut[node] = axis, cut
                self.child[node] = (self._grow(x[left], cells // 2), self._grow(x[~left], cells - cells // 2))
                return node
        self.child[node] = self.n
        self.n += 1
        return node

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each cell that the ball around a row of x meets; radius 0 gives the row's own cell."""
        rows, cells = [np.zeros(0, int)], [np.zeros(0, int)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.axis[node] is None:
                rows.append(at)
                cells.append(np.full(len(at), self.child[node]))
                continue
            v, r, cut = x[at, self.axis[node]], radius[at], self.cut[node]
            # a little wider than the radius, so that rounding loses no tie
            slack = 1e-9 * (np.abs(v) + abs(cut) + r) * (r > 0)
            todo += [(self.child[node][0], at[v - r - slack <= cut]), (self.child[node][1], at[v + r + slack > cut])]
        return np.concatenate(rows), np.concatenate(cells)


def nearest(x: np.ndarray, p: np.ndarray, n: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of p, squared distance) of the n rows of p nearest to each row of x, with all ties of the nth, up to `most`."""
    d = np.zeros((len(x), len(p)))
    for j in range(x.shape[1]):
        d += (x[:, None, j] - p[None, :, j]) ** 2
    if n < len(p):
        most = np.minimum(most, np.partition(d, n - 1, 1)[:, n - 1])
    i, j = np.nonzero(d <= most[:, None])
    return i, j, d[i, j]


def _points(df: DataFrame, cols: list[str], key: str, k: int) -> DataFrame:
    """(cols, keys): different points with their k + 1 smallest keys."""
    few = df.withColumn("__r", F.row_number().over(Window.partitionBy(*cols).orderBy(key))).where(F.col("__r") <= k + 1)
    return few.groupBy(*cols).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def knn_join(df: DataFrame, ref: DataFrame, cols: list[str], k: int, key: str = "row_id") -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest rows of `ref` by Euclidean distance, not the row itself.

    Exact over all rows. Equal points are compared once. Space is cut into cells on a bounded sample; a point's
    neighbours in its own cell bound how far the others can be, and every cell that this ball meets is searched as
    well. Cells are cut into tiles of at most BLOCK points a side. Ties go to the smaller key. Rows with a null in
    cols are left out; keys are unique.
    """
    spark, kind, name = df.sparkSession, dict(df.dtypes)[key], key
    own_names = [f"__x{j}" for j in range(len(cols))]  # so that no name of the caller meets one of the search
    clean = lambda t: t.select(F.col(key).alias("__key"), *[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(cols, own_names, strict=True)]).dropna(subset=own_names)
    df, ref, cols, key = clean(df), clean(ref), own_names, "__key"
    points = staged(_points(ref, cols, key, k), "points")
    asked = staged(df.select(*cols).distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    n = points.count()
    sample = points.orderBy(F.xxhash64(*cols)).limit(SAMPLE).select(*cols).toPandas().to_numpy(float)
    cells = spark.sparkContext.broadcast(Cells(sample, max(1, min(n // CELL, len(sample) // 8))))
    numbers = ", ".join(f"`{c}` double" for c in cols)

    def placed(t: DataFrame, more: list[str], kinds: str, first: bool = True) -> DataFrame:
        """Rows of t for each cell: its own one, or the others that its ball of radius r meets."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf[cols].to_numpy(float)
                rows, cell = cells.value.reached(x, np.zeros(len(x)) if first else pdf.r.to_numpy(float))
                if not first:
                    other = cell != pdf.cell.to_numpy()[rows]
                    rows, cell = rows[other], cell[other]
                yield pdf.iloc[rows][[*cols, *more]].assign(cell=cell)

        return t.mapInPandas(run, f"{numbers}, {kinds}, cell long")

    def tiled(t: DataFrame, name: str, other: str, sizes: DataFrame, by: str) -> DataFrame:
        """Each row once for every block of the other side."""
        block = F.pmod(F.xxhash64(by), F.col(name)).cast("int").alias(f"__{name}")  # of the type of the other side, since equal numbers of other types lie in other partitions
        return t.join(sizes, "cell").select(*t.columns, block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"__{other}"))

    home = staged(placed(points, ["keys"], f"keys array<{kind}>"), "points-by-cell")
    blocks = lambda t, name: t.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    pieces = blocks(home, "a")

    def search(q: DataFrame) -> DataFrame:
        """(q, keys, d): for each question (cols, q, cell, r), the nearest points of the cell within r."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            p, keys, out = right[cols].to_numpy(float), right["keys"].to_numpy(object), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for a in range(0, len(left) if len(p) else 0, 256):
                part = left.iloc[a : a + 256]
                row, at, d = nearest(part[cols].to_numpy(float), p, k + 1, (part.r.to_numpy(float) * (1 + 1e-9)) ** 2)
                out.append((part.q.to_numpy(np.int64)[row], at, d))
            q, at, d = map(np.concatenate, zip(*out, strict=True))
            return pd.DataFrame({"q": q, "keys": pd.Series([keys[i] for i in at], dtype=object), "d": d})

        sizes = blocks(q, "b").join(pieces, "cell")
        left, right = tiled(q, "b", "a", sizes, "q").groupBy("cell", "__a", "__b"), tiled(home, "a", "b", sizes, "keys").groupBy("cell", "__a", "__b")
        return left.cogroup(right).applyInPandas(run, f"q long, keys array<{kind}>, d double")

    def best(found: DataFrame) -> DataFrame:
        """(q, near array<struct<d, key>>): the k + 1 nearest keys of each question."""
        rows = found.select("q", "d", F.explode("keys").alias("key"))
        few = rows.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy("d", "key"))).where(F.col("__r") <= k + 1)
        return few.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "key"))).alias("near"))

    own = staged(placed(asked.withColumn("r", F.lit(float("inf"))), ["q", "r"], "q long, r double"), "asked-by-cell")
    first = staged(best(search(own)), "near-at-home")
    # the row itself may be among them, so the last of k + 1 bounds the kth neighbour; with fewer there is no bound
    last = F.when(F.size("near") > k, F.sqrt(F.element_at("near", -1)["d"])).otherwise(F.lit(float("inf")))
    wide = own.drop("r").join(first.select("q", last.alias("r")), "q", "left").withColumn("r", F.coalesce("r", F.lit(float("inf"))))
    beyond = search(staged(placed(wide, ["q", "r"], "q long, r double", first=False), "asked-beyond"))
    near = best(first.select("q", F.explode("near").alias("x")).select("q", F.array("x.key").alias("keys"), "x.d").unionByName(beyond))
    rows = df.join(asked, cols).join(near, "q")
    kept = F.slice(F.filter("near", lambda x: x["key"] != F.col(key)), 1, k)
    return rows.select(key, F.posexplode(kept).alias("pos", "x")).select(F.col(key).alias(name), F.col("x.key").alias("neighbour"), F.sqrt("x.d").alias("distance"), (F.col("pos") + 1).alias("rank"))


def ranges_of(df: DataFrame, num: list[str]) -> list[float]:
    r = df.agg(*[(F.max(c) - F.min(c)).cast("double") for c in num]).first() if num else []
    return [float(x) if x else 0.0 for x in r]


def gower(a_num: np.ndarray, b_num: np.ndarray, a_cat: np.ndarray, b_cat: np.ndarray, ranges: list[float]) -> np.ndarray:
    """Mean of range-scaled differences and mismatches over the columns that both rows have."""
    total, weight = np.zeros((len(a_num), len(b_num))), np.zeros((len(a_num), len(b_num)))
    for j, r in enumerate(ranges):
        d = np.abs(a_num[:, None, j] - b_num[None, :, j]) / r if r > 0 else np.abs(a_num[:, None, j] - b_num[None, :, j]) * 0
        ok = ~np.isnan(d)
        total += np.where(ok, d, 0)
        weight += ok
    for j in range(a_cat.shape[1]):
        a, b = coded(a_cat[:, j], b_cat[:, j])
        ok = (a >= 0)[:, None] & (b >= 0)[None, :]
        total += ok & (a[:, None] != b[None, :])
        weight += ok
    return total / np.maximum(weight, 1)


def coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as equal numbers where they are equal, nulls as -1: pairs of numbers are compared faster than pairs of objects."""
    codes = pd.factorize(np.concatenate([a, b]))[0]
    return codes[: len(a)], codes[len(a) :]


def nearest_rep(df: DataFrame, reps: pd.DataFrame, num: list[str], cat: list[str], ranges: list[float], key: str, label: str = "cluster") -> DataFrame:
    """(key, label, distance) of the representative nearest by Gower distance; reps is a short table with `label`."""
    held = df.sparkSession.sparkContext.broadcast((reps[num].to_numpy(float), reps[cat].to_numpy(object), reps[label].to_numpy(int)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rn, rc, names = held.value
        for pdf in batches:
            if len(pdf):
                d = gower(pdf[num].to_numpy(float), rn, pdf[cat].to_numpy(object), rc, ranges)
                i = d.argmin(1)
                yield pd.DataFrame({key: pdf[key], label: names[i], "distance": d[np.arange(len(d)), i]})

    return df.select(key, *num, *cat).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {label} int, distance double")
