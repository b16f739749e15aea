"""Mixed (Gower) distances over all rows: exact silhouettes and exact nearest neighbours.

The distance of two rows is the mean, over the columns that both have, of differences as shares of the column's
range (numbers) and of mismatches (labels); rows without a common column are at distance 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.neighbours import BLOCK, CELL, SAMPLE, Cells
from tarmac.sources.stages import staged

#: Groups of rows that one pass of silhouettes sums for, most cells of the search index.
PASS, MOST_CELLS = 128, 16_384
#: Rows wanted in a bucket of values, most sums of values by column, bucket and group.
PIECE, MOST_SUMS = 16_384, 1 << 20


def _numbered(num: list[str], cat: list[str]) -> tuple[list[Column], list[Column], Column]:
    """Numbers, labels, and a number whose bits say which of them a row has."""
    x = [F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) + 0.0 for c in num]
    s = [F.col(c).cast("string") for c in cat]
    has = sum((F.when(c.isNotNull(), F.lit(1 << j)).otherwise(F.lit(0)) for j, c in enumerate([*x, *s])), F.lit(0)).cast("long")
    return x, s, has


# silhouettes


def gower_silhouettes(df: DataFrame, num: list[str], cat: list[str], label: str, key: str = "row_id") -> DataFrame:
    """(key, label, a, b, silhouette) of every row by mixed distance, exact, without pairs of rows.

    a is the mean distance to the other rows of the row's label, b the smallest mean distance to the rows of another one.
    Rows without a label are left out; a label of one row has silhouette 0; with one label alone, b and silhouette are null.
    """
    out, labels = _silhouettes(df, num, cat, [label], key)
    name = F.get(F.array(*[F.lit(one) for one in labels[0]]), F.col("__c0")) if labels[0] else F.lit(None)
    return out.where("__c0 >= 0").select(F.col("__key").alias(key), name.cast(dict(df.dtypes)[label]).alias(label), F.col("a0").alias("a"), F.col("b0").alias("b"), F.col("silhouette0").alias("silhouette"))


def gower_silhouette(df: DataFrame, num: list[str], cat: list[str], label: str, key: str = "row_id") -> float | None:
    """Mean silhouette of all rows by mixed distance; null with one label."""
    return mean_silhouettes(df, num, cat, [label], key)[0]


def mean_silhouettes(df: DataFrame, num: list[str], cat: list[str], labels: list[str], key: str = "row_id") -> list[float | None]:
    """gower_silhouette of several labellings, in the same passes."""
    out, _ = _silhouettes(df, num, cat, labels, key)
    return list(out.agg(*[F.avg(f"silhouette{i}") for i in range(len(labels))]).first())


def _silhouettes(df: DataFrame, num: list[str], cat: list[str], names: list[str], key: str) -> tuple[DataFrame, list[list]]:
    """(__key, and __c, a, b, silhouette with the number of each labelling), and the labels that the codes __c stand for."""
    x, s, has = _numbered(num, cat)
    many = range(len(names))
    rows = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__l{i}") for i, c in enumerate(names)], has.alias("__has"), *[F.coalesce(v, F.lit(0.0)).alias(f"__x{j}") for j, v in enumerate(x)], *[F.when(v.isNotNull(), F.xxhash64(v)).otherwise(F.lit(0)).alias(f"__x{len(x) + j}") for j, v in enumerate(s)])
    rows = staged(rows, "silhouette-rows")
    found = [[(r[f"__l{i}"], r["__has"], r["n"]) for r in rows.where(f"__l{i} is not null").groupBy(f"__l{i}", "__has").agg(F.count("*").alias("n")).collect()] for i in many]  # labels times sets of columns
    labels = [sorted({g[0] for g in f}, key=str) for f in found]
    size = [[sum(n for one, _, n in f if one == name) for name in known] for f, known in zip(found, labels, strict=True)]
    groups = [(i, labels[i].index(one), h, n) for i in many for one, h, n in sorted(found[i], key=str)]
    code = [F.coalesce(*[F.when(F.col(f"__l{i}") == F.lit(one), F.lit(c)) for c, one in enumerate(labels[i])], F.lit(-1)).cast("int").alias(f"__c{i}") for i in many]
    lim = [F.when(F.col("__has").bitwiseAND(F.lit(1 << j)) != 0, F.col(f"__x{j}")) for j in range(len(num))]
    limits = rows.agg(*[f(v) for v in lim for f in (F.min, F.max)]).first() if num else []
    scaled = [((F.col(f"__x{j}") - float(lo)) / (float(hi) - float(lo)) if lo is not None and hi > lo else F.lit(0.0)).alias(f"__x{j}") for j, (lo, hi) in enumerate(zip(limits[::2], limits[1::2], strict=True))]
    rows = rows.select("__key", *code, "__has", *scaled, *[f"__x{len(num) + j}" for j in range(len(cat))])
    first = [sum(map(len, labels[:i])) for i in range(len(names) + 1)]  # of the sums __d of a labelling
    ds, codes = [f"__d{l}" for l in range(first[-1])], [f"__c{i}" for i in many]
    parts = [_sums(rows, groups[a : a + PASS], labels, len(num), len(cat)) for a in range(0, len(groups), PASS)]
    out = parts[0] if parts else rows.select("__key", *codes)
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("__key", *codes).agg(*[F.sum(d).alias(d) for d in ds])
    for i in many:
        own, sizes = F.col(f"__c{i}"), F.array(*map(F.lit, size[i])).cast("array<long>")
        d = F.array(*[F.col(c) for c in ds[first[i] : first[i + 1]]]).cast("array<double>")
        a = F.get(d, own) / F.greatest(F.get(sizes, own) - 1, F.lit(1))
        b = F.array_min(F.filter(F.transform(d, lambda v, l: F.when(l != own, v / F.get(sizes, l))), lambda v: v.isNotNull()))
        out = out.withColumns({f"a{i}": F.when(own >= 0, a), f"b{i}": F.when(own >= 0, b)})
        share = F.when(F.get(sizes, own) <= 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col(f"b{i}") - F.col(f"a{i}"), F.greatest(f"a{i}", f"b{i}")), F.lit(0.0)))
        out = out.withColumn(f"silhouette{i}", F.when(F.col(f"b{i}").isNotNull(), share))
    return out, labels


def _cuts(v: np.ndarray, pieces: int, most: int) -> np.ndarray:
    """Lower ends of buckets, from sorted sampled values: each value its own, or, beyond `most`, equal shares with frequent values apart."""
    after = (lambda u: np.nextafter(u, np.inf)) if v.dtype == float else (lambda u: u + 1)
    u = np.unique(v)
    if len(u) <= most:
        return np.unique(np.concatenate([u, after(u)]))
    q, n = np.unique(v[np.linspace(0, len(v) - 1, pieces + 1).astype(int)], return_counts=True)
    return np.unique(np.concatenate([q, after(q[n > 1])]))


def _sums(rows: DataFrame, groups: list[tuple], labels: list[list], n_num: int, n_cat: int) -> DataFrame:
    """(__key, __c.., __d..): the sums of a row's distances to the rows of each label, over `groups` of (labelling, label, has, n).

    The sum of a row's distances to a group of rows that have the same columns splits by column: for a label it is
    the number of rows of the group of another level; for a number v it is v * (below - above) + (sum above - sum
    below). Values are counted in buckets that a sample cuts; frequent values are buckets of their own. Where a
    bucket holds one value, the counts of all buckets give the sum, and rows are not moved. Else the rows of a bucket, one column after
    the other, come together and add what lies inside it. Labels are compared by 64-bit hashes.
    """
    spark, wide, g = rows.sparkSession, range(n_num + n_cat), len(groups)
    xs, codes = [f"__x{j}" for j in wide], [f"__c{i}" for i in range(len(labels))]
    first = np.cumsum([0, *map(len, labels)])
    ds = [f"__d{l}" for l in range(first[-1])]
    n = max(sum(r[3] for r in groups if r[0] == i) for i in range(len(labels)))
    share = min(1.0, SAMPLE / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("__key", F.lit(11)), F.lit(1 << 30)) < F.lit(share * (1 << 30))).select("__has", *xs).toPandas()
    pieces, most = -(-n // PIECE), max(1, MOST_SUMS // (g * max(1, len(wide))))
    cuts = []
    for j in wide:
        v = np.sort(sample[f"__x{j}"].to_numpy(float if j < n_num else np.int64)[(sample["__has"].to_numpy(np.int64) >> j) & 1 == 1])
        cuts.append(_cuts(v, max(1, min(pieces, most, len(v) // 8)), most))
    sets = np.unique([r[2] for r in groups])
    place = np.full((len(labels), max(map(len, labels)) + 1, len(sets)), -1)  # the group of (labelling, label, columns); the last label is none
    into = np.zeros((g, first[-1]))
    every = np.unique([r["__has"] for r in rows.select("__has").distinct().collect()])
    weight = np.zeros((len(every), g))
    for at, (i, one, h, _) in enumerate(groups):
        place[i, one, np.searchsorted(sets, h)] = at
        into[at, first[i] + one] = 1.0
        weight[:, at] = 1 / np.maximum(np.bitwise_count(every & h), 1)

    def of_group(pdf: pd.DataFrame) -> list[np.ndarray]:
        has = pdf["__has"].to_numpy(np.int64)
        p = np.minimum(np.searchsorted(sets, has), len(sets) - 1)
        return [np.where(sets[p] == has, place[i, pdf[c].to_numpy(int), p], -1) for i, c in enumerate(codes)]

    def value(pdf: pd.DataFrame, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of a column, their buckets, and who has one."""
        v = pdf[f"__x{j}"].to_numpy(float if j < n_num else np.int64)
        return v, np.searchsorted(cuts[j], v, "right"), (pdf["__has"].to_numpy(np.int64) >> j) & 1 == 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = [np.zeros((len(c) + 1) * g, np.int64) for c in cuts]
        total = [np.zeros((len(c) + 1) * g) for c in cuts]
        low = [np.full(len(c) + 1, np.inf if j < n_num else np.iinfo(np.int64).max, c.dtype) for j, c in enumerate(cuts)]
        high = [np.full(len(c) + 1, -np.inf if j < n_num else np.iinfo(np.int64).min, c.dtype) for j, c in enumerate(cuts)]
        for pdf in batches:
            of = of_group(pdf)
            for j in wide:
                v, b, ok = value(pdf, j)
                np.minimum.at(low[j], b[ok], v[ok])
                np.maximum.at(high[j], b[ok], v[ok])
                for at in of:
                    use = ok & (at >= 0)
                    np.add.at(number[j], b[use] * g + at[use], 1)
                    if j < n_num:
                        np.add.at(total[j], b[use] * g + at[use], v[use])
        for j in wide:
            cell, held = np.flatnonzero(number[j]), np.flatnonzero(low[j] <= high[j])
            yield pd.DataFrame({"j": j, "b": cell // g, "g": cell % g, "n": number[j][cell], "t": total[j][cell], "one": True, "low": 0, "v": 0.0})
            yield pd.DataFrame({"j": j, "b": held, "g": -1, "n": 0, "t": 0.0, "one": low[j][held] == high[j][held], "low": low[j][held].view(np.int64), "v": low[j][held].astype(float)})

    # group -1 says what a bucket holds, of all rows: of one value where each task has one, of the same bits
    cells = rows.select("__has", *codes, *xs).mapInPandas(count, "j int, b int, g int, n long, t double, one boolean, low long, v double")
    cells = cells.groupBy("j", "b", "g").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.min("one").alias("one"), F.min("low").alias("least"), F.max("low").alias("most"), F.min("v").alias("v")).toPandas()  # MOST_SUMS or so
    tables = []
    for j in wide:
        bucket = cells[(cells.j == j) & (cells.g < 0)].set_index("b")
        c = cells[(cells.j == j) & (cells.g >= 0)]
        shape = (len(cuts[j]) + 1, g)
        number, total, mixed = np.zeros(shape), np.zeros(shape), np.zeros(shape[0], bool)
        number[c.b, c.g], total[c.b, c.g] = c.n, c.t
        mixed[bucket.index] = ~bucket.one.astype(bool) | (bucket.least != bucket.most)
        at = np.zeros(shape[0])
        at[bucket.index] = bucket.v
        if j < n_num:
            far = at[:, None] * (2 * number.cumsum(0) - number.sum(0)) + total.sum(0) - 2 * total.cumsum(0)
            tables.append((mixed, far, number.cumsum(0) - number, total.cumsum(0) - total, number.sum(0), total.sum(0)))
        else:
            tables.append((mixed, number.sum(0) - number, None, None, number.sum(0), None))
    moved = [j for j in wide if tables[j][0].any()]
    held = spark.sparkContext.broadcast(tables)
    spread = max(1, pieces)

    def named(pdf: pd.DataFrame, out: np.ndarray, step: int) -> pd.DataFrame:
        """Rows with their sums, and where they go next: to their bucket, or, with nothing to add there, anywhere."""
        got = pdf[["__key", *codes, "__has", *[f"__x{j}" for j in moved[step:]]]].assign(**{d: out[:, l] for l, d in enumerate(ds)})
        if step < len(moved):
            _, b, ok = value(pdf, moved[step])
            got["__b"] = np.where(ok & held.value[moved[step]][0][b], b, -1 - np.arange(len(pdf)) % spread)
        return got

    def weights(pdf: pd.DataFrame) -> np.ndarray:
        return weight[np.searchsorted(every, pdf["__has"].to_numpy(np.int64))]

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), 4096):
                pdf = whole.iloc[a : a + 4096]
                far = np.zeros((len(pdf), g))
                for j in wide:
                    _, b, ok = value(pdf, j)
                    ok &= ~held.value[j][0][b]
                    far[ok] += held.value[j][1][b[ok]]
                yield named(pdf, (far * weights(pdf)) @ into, 0)

    def inside(step: int):
        j = moved[step]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = pdf[ds].to_numpy(float)
            at = int(pdf["__b"].iloc[0])
            if at >= 0:
                _, _, below, sum_below, number, total = held.value[j]
                v, _, _ = value(pdf, j)
                mine = np.zeros((len(pdf), g))
                for of in of_group(pdf):
                    mine[np.flatnonzero(of >= 0), of[of >= 0]] = 1.0
                if j < n_num:
                    order = np.argsort(v, kind="stable")
                    n_to, t_to = np.empty_like(mine), np.empty_like(mine)
                    n_to[order], t_to[order] = mine[order].cumsum(0), (mine[order] * v[order, None]).cumsum(0)
                    far = v[:, None] * (2 * (below[at] + n_to) - number) + total - 2 * (sum_below[at] + t_to)
                else:
                    u, k = np.unique(v, return_inverse=True)
                    same = np.zeros((len(u), g))
                    np.add.at(same, k, mine)
                    far = number - same[k]
                out = out + (far * weights(pdf)) @ into
            return named(pdf, out, step + 1)

        return run

    kinds = dict(rows.dtypes)
    schema = lambda step: ", ".join([*[f"{c} {kinds[c]}" for c in ["__key", *codes, "__has", *[f"__x{j}" for j in moved[step:]]]], *[f"{d} double" for d in ds], *(["__b int"] if step < len(moved) else [])])
    out = rows.mapInPandas(settled, schema(0))
    for step in range(len(moved)):
        out = out.groupBy("__b").applyInPandas(inside(step), schema(step + 1))
    return out.select("__key", *codes, *ds)


# neighbours


class Index:
    """Cells of donors: which columns they have, levels of some label columns, a box of numbers, how many donors."""

    def __init__(self, cells: pd.DataFrame, n_num: int, n_cat: int, known: list[int], ranges: list[float]):
        """known: the label columns that cells are told apart by; the others may mismatch or not."""
        self.has, self.count = cells["has"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
        self.low, self.high = (np.array(cells[c].tolist(), float).reshape(len(cells), n_num) for c in ("low", "high"))
        self.levels = np.array(cells["levels"].tolist(), np.int64).reshape(len(cells), len(known))
        self.n_num, self.n_cat, self.known, self.ranges = n_num, n_cat, known, ranges

    def bounds(self, x: np.ndarray, s: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): smallest and largest distance that a donor of the cell can have."""
        both = has[:, None] & self.has[None, :]
        low, high = np.zeros(both.shape), np.zeros(both.shape)
        for j, r in enumerate(self.ranges):
            if r > 0:
                ok, v = (both >> j) & 1, x[:, None, j]
                under, over = self.low[None, :, j] - v, v - self.high[None, :, j]
                low += ok * np.maximum(0, np.maximum(under, over)) / r
                high += ok * np.maximum(np.abs(under), np.abs(over)) / r
        for j in range(self.n_cat):
            ok = (both >> (self.n_num + j)) & 1
            if j in self.known:
                ok = ok * (s[:, None, j] != self.levels[None, :, self.known.index(j)])
                low += ok
            high += ok
        weight = np.maximum(np.bitwise_count(both), 1)
        return low / weight, high / weight


def mixed_distance(x: np.ndarray, s: np.ndarray, has: np.ndarray, px: np.ndarray, ps: np.ndarray, phas: np.ndarray, ranges: list[float]) -> np.ndarray:
    """Distances of rows (numbers, hashes of labels, bits of what is there)."""
    both = has[:, None] & phas[None, :]
    d = np.zeros(both.shape)
    for j, r in enumerate(ranges):
        if r > 0:
            d += np.where((both >> j) & 1, np.abs(x[:, None, j] - px[None, :, j]) / r, 0.0)
    for j in range(s.shape[1]):
        d += ((both >> (len(ranges) + j)) & 1) & (s[:, None, j] != ps[None, :, j])
    return d / np.maximum(np.bitwise_count(both), 1)


def nearest_mixed(asked: DataFrame, donors: DataFrame, num: list[str], cat: list[str], value: str, k: int, ranges: list[float], key: str = "row_id") -> DataFrame:
    """(key, near array<struct<d, key, value>>): the k donors nearest to each row by mixed distance, of all donors, ties to the smaller key.

    Equal donors are searched as one, with their k smallest keys, and so are equal rows that ask. Donors are placed in cells by
    the columns that they have, their labels (as many label columns as leave at most MOST_CELLS combinations, those of
    fewest levels first) and boxes of numbers that are cut on a sample. The index of cells bounds the distance to any of their donors. A row
    first searches the cells that are sure to hold k donors, by largest distances; the kth distance found is then the radius, and
    every other cell whose smallest distance is not beyond it is searched as well. Cells are cut into tiles of BLOCK donors.
    Labels are compared by 64-bit hashes.
    """
    spark, kind = donors.sparkSession, dict(donors.dtypes)
    x, s, has = _numbered(num, cat)
    xs, ss = [f"__x{j}" for j in range(len(num))], [f"__s{j}" for j in range(len(cat))]
    point = [*xs, *ss, "__has"]
    flat = [*[F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(x, xs, strict=True)], *[F.when(v.isNotNull(), F.xxhash64(v)).otherwise(F.lit(0)).alias(n) for v, n in zip(s, ss, strict=True)], has.alias("__has")]
    kinds = ", ".join([*[f"{n} double" for n in xs], *[f"{n} long" for n in ss], "__has long"])
    ask = asked.select(F.col(key).alias("__key"), *flat)
    give = donors.select(F.col(key).alias("__key"), F.col(value).alias("__value"), *flat)

    few = give.withColumn("__r", F.row_number().over(Window.partitionBy(*point).orderBy("__key"))).where(F.col("__r") <= k)
    points = staged(few.groupBy(*point).agg(F.sort_array(F.collect_list(F.struct(F.col("__key").alias("key"), F.col("__value").alias("value")))).alias("__keys")), "donor-points")
    questions = staged(ask.select(*point).distinct().withColumn("q", F.monotonically_increasing_id()), "questions")

    # label columns by number of levels; the first ones whose combinations, with the columns that are there, are few enough
    levels = points.agg(F.count("*").alias("n"), *[F.approx_count_distinct(n).alias(n) for n in ss]).first()
    by = sorted(range(len(ss)), key=lambda j: (levels[ss[j]], j))
    sets = points.agg(*[F.approx_count_distinct(F.struct("__has", *[ss[j] for j in by[:i]])).alias(str(i)) for i in range(len(ss) + 1)]).first()
    known = sorted(by[: max([i for i in range(len(ss) + 1) if sets[str(i)] <= MOST_CELLS // 4], default=0)])
    boxes = max(1, min(levels.n // CELL, MOST_CELLS // max(1, sets[str(len(known))])))
    sample = points.orderBy(F.xxhash64(*point)).limit(SAMPLE).select(*xs).toPandas().to_numpy(float) if xs else np.zeros((0, 0))
    scale = np.array([1 / r if r > 0 else 0.0 for r in ranges])
    cut = spark.sparkContext.broadcast(Cells(sample * scale, min(boxes, max(1, len(sample) // 8))) if xs and len(sample) else None)

    def boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            box = np.zeros(len(pdf), np.int64)
            if cut.value is not None:
                i, c = cut.value.reached(pdf[xs].to_numpy(float) * scale, np.zeros(len(pdf)))
                box[i] = c
            yield pdf[point].assign(box=box)

    named = points.select(*point).mapInPandas(boxed, f"{kinds}, box long")
    same = ["__has", *[ss[j] for j in known], "box"]
    home = staged(points.join(named, point).withColumn("__cell", F.xxhash64(*same)), "donors-by-cell")
    cells = home.groupBy("__cell", *same).agg(F.count("*").alias("n"), F.array(*[F.min(n) for n in xs]).cast("array<double>").alias("low"), F.array(*[F.max(n) for n in xs]).cast("array<double>").alias("high"))
    cells = cells.select("__cell", F.col("__has").alias("has"), "n", "low", "high", F.array(*[F.col(ss[j]) for j in known]).cast("array<long>").alias("levels")).toPandas()  # MOST_CELLS or so
    ids, index = cells["__cell"].to_numpy(np.int64), Index(cells, len(num), len(cat), known, ranges)
    held = spark.sparkContext.broadcast((ids, index))

    def placed(q: DataFrame, first: bool) -> DataFrame:
        """Questions (point, q, r) for each cell that they search: those sure to hold k donors, or the others within r."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, index = held.value
            for whole in batches:
                for a in range(0, len(whole), 64):
                    pdf = whole.iloc[a : a + 64]
                    low, high = index.bounds(pdf[xs].to_numpy(float), pdf[ss].to_numpy(np.int64), pdf["__has"].to_numpy(np.int64))
                    order = np.argsort(high, 1, kind="stable")
                    before = np.cumsum(index.count[order], 1) - index.count[order]
                    sure = np.zeros(low.shape, bool)
                    np.put_along_axis(sure, order, before < k, 1)
                    i, c = np.nonzero(sure if first else ~sure & (low <= pdf["r"].to_numpy(float)[:, None] * (1 + 1e-9) + 1e-12))
                    yield pdf.iloc[i].assign(__cell=ids[c])

        return q.mapInPandas(run, f"{kinds}, q long, r double, __cell long")

    blocks = lambda t, name: t.groupBy("__cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    pieces = blocks(home, "a")

    def tiled(t: DataFrame, name: str, other: str, sizes: DataFrame) -> DataFrame:
        """Each row once for every block of the other side."""
        block = F.pmod(F.xxhash64(*point), F.col(name)).cast("int").alias(f"__{name}")  # of the type of the other side, since equal numbers of other types lie in other partitions
        return t.join(sizes, "__cell").select(*t.columns, block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"__{other}"))

    found_kind = f"q long, d double, keys array<struct<key:{kind[key]},value:{kind[value]}>>"

    def search(q: DataFrame) -> DataFrame:
        """(q, d, keys): the k best points of each tile for each question."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            px, ps, phas, keys, out = right[xs].to_numpy(float), right[ss].to_numpy(np.int64), right["__has"].to_numpy(np.int64), right["__keys"].to_numpy(object), []
            if not len(left) or not len(right):
                return pd.DataFrame({"q": [], "d": [], "keys": []}, dtype=object)  # a block may meet none; empty floats are no lists to Arrow
            least = np.empty(len(keys), object)
            least[:] = [x[0]["key"] for x in keys]
            rank = np.argsort(np.argsort(least, kind="stable"), kind="stable")
            for a in range(0, len(left), 256):
                part = left.iloc[a : a + 256]
                d = mixed_distance(part[xs].to_numpy(float), part[ss].to_numpy(np.int64), part["__has"].to_numpy(np.int64), px, ps, phas, ranges)
                most = np.minimum(part["r"].to_numpy(float), np.partition(d, k - 1, 1)[:, k - 1] if len(px) > k else np.inf)
                i, j = np.nonzero(d <= most[:, None])
                v = d[i, j]
                at = np.lexsort((rank[j], v, i))
                i, j, v = i[at], j[at], v[at]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((part["q"].to_numpy(np.int64)[i[kept]], v[kept], j[kept]))
            q, v, j = map(np.concatenate, zip(*out, strict=True))
            return pd.DataFrame({"q": q, "d": v, "keys": pd.Series([keys[i] for i in j], dtype=object)})

        sizes = blocks(q, "b").join(pieces, "__cell")
        left, right = tiled(q, "b", "a", sizes).groupBy("__cell", "__a", "__b"), tiled(home, "a", "b", sizes).groupBy("__cell", "__a", "__b")
        return left.cogroup(right).applyInPandas(run, found_kind)

    def best(found: DataFrame) -> DataFrame:
        rows = found.select("q", "d", F.explode("keys").alias("x")).select("q", "d", "x.key", "x.value")
        top = rows.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy("d", "key"))).where(F.col("__r") <= k)
        return top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "key", "value"))).alias("near"))

    first = staged(best(search(staged(placed(questions.withColumn("r", F.lit(float("inf"))), True), "asked-at-home"))), "near-at-home")
    radius = F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
    wide = questions.join(first.select("q", radius.alias("r")), "q", "left").withColumn("r", F.coalesce("r", F.lit(float("inf")))).select(*point, "q", "r")
    beyond = search(staged(placed(wide, False), "asked-beyond"))
    at_home = first.select("q", F.explode("near").alias("x")).select("q", "x.d", F.array(F.struct("x.key", "x.value")).alias("keys"))
    near = best(at_home.unionByName(beyond))
    return ask.join(questions, point).join(near, "q").select(F.col("__key").alias(key), "near")
