"""Factor analysis. Matrices of p by p are summed in Spark and solved on the driver; rows are projected in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.inference import anova
from tarmac.operators.summary import contingency
from tarmac.sources.stages import staged

MOST_COLUMNS, MOST_CELLS = 500, 1_000_000
#: Most terms whose vectors the driver holds, cells that a task multiplies at once, blocks of vectors before a new start.
MOST_TERMS, CELLS_AT_ONCE, BLOCKS = 1_000_000, 250_000, 16
#: Numbers in the blocks and their images that the driver holds together, three blocks at least; terms in a row of partial products.
HELD, TERMS_AT_ONCE = 40_000_000, 4096
CA_ROWS = "side string, category string, axis int, coord double, contribution double, cos2 double"


def eigen_table(spark, values: np.ndarray) -> DataFrame:
    """(axis, eigenvalue, percent, cumulative)."""
    total = max(values.sum(), 1e-300)
    c = np.cumsum(values) * 100 / total
    return spark.createDataFrame([(i + 1, float(v), float(v * 100 / total), float(c[i])) for i, v in enumerate(values)], "axis int, eigenvalue double, percent double, cumulative double")


def retain(eig: DataFrame, p: int) -> DataFrame:
    """Axes whose eigenvalue exceeds 1/p."""
    return eig.where(F.col("eigenvalue") > 1 / p)


def choose_dims(eig: DataFrame, percent: float = 40, least: int = 5, most: int = 12) -> int:
    """The first number of axes that explains `percent`, between the limits."""
    n = eig.where(F.col("cumulative") >= percent).agg(F.min("axis")).first()[0] or most
    return int(min(max(n, least), most, eig.count()))


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with the entry of largest size made positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def gram(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Sums of products of (1, cols), one partial matrix per partition."""
    if len(cols) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    p = len(cols) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for pdf in batches:
            m = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)])
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(p), p), "j": np.tile(np.arange(p), p), "v": total.ravel()})

    out = np.zeros((p, p))
    for r in df.select(*cols).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


@dataclass
class Axes:
    """Fitted axes: columns of indicators and numbers, their centre, scale and loadings."""

    columns: list[tuple[str, str | None]]
    centre: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    values: np.ndarray
    active: int = 0  # categorical columns of a multiple correspondence analysis

    def project(self, df: DataFrame, ncp: int, keep: list[str]) -> DataFrame:
        """keep and dim_1..dim_ncp of every row, as sums of weighted columns, which are compiled."""
        x = [(F.col(c).cast("double") if level is None else F.coalesce(F.col(c).cast("string") == level, F.lit(False)).cast("double")).alias(f"__x{i}") for i, (c, level) in enumerate(self.columns)]
        weights, base = self.loadings / self.scale[:, None], (self.centre / self.scale) @ self.loadings
        dims = [(reduce(lambda a, b: a + b, [F.col(f"__x{i}") * float(w) for i, w in enumerate(weights[:, k])]) - float(base[k])).alias(f"dim_{k + 1}") for k in range(min(ncp, self.loadings.shape[1]))]
        return df.select(*keep, *x).select(*keep, *dims)

    def variables(self, spark) -> DataFrame:
        """(variable, level, axis, coord, contribution in percent).

        coord is a number's correlation with the axis, or the mean coordinate of the rows of a level; in a multiple
        correspondence analysis that mean over the root of the eigenvalue.
        """
        share = self.loadings**2 / np.maximum((self.loadings**2).sum(0), 1e-300) * 100

        def coord(j: int, k: int) -> float:
            v, value = self.loadings[j, k], self.values[k]
            if self.active:
                return v * np.sqrt(value) * self.active / self.scale[j]
            return v * np.sqrt(value) if self.columns[j][1] is None else v * value / self.scale[j]

        rows = [(c, level, k + 1, float(coord(j, k)), float(share[j, k])) for j, (c, level) in enumerate(self.columns) for k in range(self.loadings.shape[1])]
        return spark.createDataFrame(rows, "variable string, level string, axis int, coord double, contribution double")


def _levels(df: DataFrame, cat: list[str]) -> list[tuple[str, str]]:
    if not cat:
        return []
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in cat]).unpivot([], cat, "v", "l").where("l is not null").distinct().limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} levels")
    return sorted((r.v, r.l) for r in rows)


def famd(df: DataFrame, num: list[str], cat: list[str], ncp: int = 8) -> Axes:
    """Numbers standardised, indicators divided by the root of their share, then principal axes. Rows with nulls
    are left out of the fit. Eigenvalues sum to numbers plus levels minus categorical columns."""
    d = df.dropna(subset=[*num, *cat])
    columns = [(c, None) for c in num] + list(_levels(d, cat))
    wide = d.select(*[(F.col(c).cast("double") if level is None else (F.col(c).cast("string") == level).cast("double")).alias(f"x{i}") for i, (c, level) in enumerate(columns)])
    g = gram(wide, [f"x{i}" for i in range(len(columns))])
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    scale = np.array([np.sqrt(max(cov[i, i], 1e-300)) if level is None else np.sqrt(max(mean[i], 1e-300)) for i, (_, level) in enumerate(columns)])
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    values = np.maximum(values[order], 0)
    return Axes(columns, mean, scale, signed(vectors[:, order[:ncp]]), values)


def mca(df: DataFrame, active: list[str], ncp: int = 10) -> Axes:
    """Multiple correspondence analysis: the categorical case, with eigenvalues divided by the number of columns."""
    axes = famd(df, [], active, ncp)
    axes.values = axes.values / len(active)
    axes.loadings, axes.active = axes.loadings / np.sqrt(len(active)), len(active)
    return axes


def pca(df: DataFrame, cols: list[str], k: int = 2) -> Axes:
    """Principal axes of standardised numbers."""
    return famd(df, cols, [], k)


def supplementary(coords: DataFrame, cols: list[str], dims: list[str]) -> DataFrame:
    """(variable, level, n, mean coordinate on each axis) of categorical columns that weren't active."""
    long = coords.select(*dims, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(dims, cols, "variable", "level").where("level is not null")
    return long.groupBy("variable", "level").agg(F.count("*").alias("n"), *[F.avg(d).alias(d) for d in dims])


def supplementary_numeric(coords: DataFrame, cols: list[str], dims: list[str]) -> DataFrame:
    """(variable, axis, r): correlations of numbers that weren't active."""
    one = coords.agg(*[F.corr(c, d).alias(f"{c}|{d}") for c in cols for d in dims])
    return one.unpivot([], [f"`{c}|{d}`" for c in cols for d in dims], "pair", "r").select(F.split("pair", r"\|")[0].alias("variable"), F.split("pair", r"\|")[1].alias("axis"), "r")


def individuals(coords: DataFrame, dims: list[str], values: np.ndarray) -> DataFrame:
    """coords with squared cosines (within the given axes) and contributions in percent per axis."""
    n = coords.count()
    total = sum((F.col(d) ** 2 for d in dims), F.lit(0.0))
    return coords.withColumns({f"cos2_{d}": F.try_divide(F.col(d) ** 2, total) for d in dims} | {f"contrib_{d}": F.col(d) ** 2 * 100 / (n * max(float(v), 1e-300)) for d, v in zip(dims, values, strict=False)})


def dimdesc(coords: DataFrame, num: list[str], cat: list[str], dims: list[str], alpha: float = 0.05) -> DataFrame:
    """(axis, variable, kind, value, p): correlations with numbers and R2 with categories, of p up to alpha."""
    from tarmac.functions.stats import t_p

    n = coords.count()
    r = supplementary_numeric(coords, num, dims).withColumn("kind", F.lit("correlation")).withColumnRenamed("r", "value")
    t = F.col("value") * F.sqrt((n - 2) / F.greatest(1 - F.col("value") ** 2, F.lit(1e-300)))
    out = r.withColumn("p", t_p(t, F.lit(n - 2))).select("axis", "variable", "kind", "value", "p")
    for c in cat:
        a = anova(coords, dims, c)
        r2 = F.col("f") * F.col("df1") / (F.col("f") * F.col("df1") + F.col("df2"))
        out = out.union(a.select(F.col("variable").alias("axis"), F.lit(c).alias("variable"), F.lit("r2").alias("kind"), r2.alias("value"), F.col("p_value_descriptive").alias("p")))
    return out.where(F.col("p") <= alpha)


def top_contributions(variables: DataFrame, axis: int, n: int = 20) -> DataFrame:
    return variables.where(F.col("axis") == axis).orderBy(F.desc("contribution"), "variable", "level").limit(n)


def top_individuals(coords: DataFrame, rows: DataFrame, key: str, dims: list[str], n: int = 30) -> DataFrame:
    """The n rows of the largest summed squared coordinates, with their original columns."""
    best = coords.withColumn("score", sum((F.col(d) ** 2 for d in dims), F.lit(0.0))).orderBy(F.desc("score"), key).limit(n)
    return rows.join(F.broadcast(best.select(key, "score")), key)


def ca(df: DataFrame, r: str, c: str, ncp: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Correspondence analysis of a contingency table: eigenvalues, and (side, category, axis, coord, contribution, cos2).

    All axes of a table of at most MOST_CELLS cells; with ncp, the first ncp axes of a table of any size (ca_sparse).
    """
    spark = df.sparkSession
    if ncp:
        counts = df.where(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(F.col(r).cast("string").alias("row"), F.col(c).cast("string").alias("col")).agg(F.count("*").alias("n"))
        return ca_sparse(counts, ncp)
    cells = contingency(df, r, c).select("row_cat", "col_cat", "n").limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"a table of more than {MOST_CELLS} cells: say how many axes are wanted (ncp)")
    t = cells.pivot(index="row_cat", columns="col_cat", values="n").sort_index().sort_index(axis=1)
    return _ca(spark, t.to_numpy(float), list(t.index), list(t.columns))


def ca_sparse(cells: DataFrame, ncp: int, extra: int = 6, rounds: int = 300, tol: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """The first ncp axes of a table of counts (row, col, n), of any size: as ca().

    Subspace iteration on the scaled table, whose cells are all that is kept: ncp + extra vectors on the columns are carried to the rows and
    back, each way one join and one sum, the known first pair (square roots of the masses) is taken out, and they are made orthonormal
    again from their products, small matrices on the driver. It ends when the eigenvalues stand still. Signs make the row coordinate
    of largest size positive.
    """
    spark = cells.sparkSession
    cells = staged(cells.where("n > 0").groupBy(F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col")).agg(F.sum("n").cast("double").alias("n")), "ca-counts")
    n = cells.agg(F.sum("n")).first()[0] or 0.0
    rows, cols = (staged(cells.groupBy(x).agg((F.sum("n") / n).alias("m")), "ca-masses") for x in ("row", "col"))
    q = min(ncp + extra, rows.count() - 1, cols.count() - 1)
    if q < 1:
        return eigen_table(spark, np.zeros(0)), spark.createDataFrame([], CA_ROWS)
    table = cells.join(rows.withColumnRenamed("m", "a"), "row").join(cols.withColumnRenamed("m", "b"), "col")
    table = staged(table.select("row", "col", (F.col("n") / n / F.sqrt(F.col("a") * F.col("b"))).alias("w"), (F.col("n") / n).alias("p"), "a", "b"), "ca-cells")
    total = table.agg(F.sum(F.col("w") ** 2)).first()[0] - 1
    axes = range(q)

    def carried(vectors: DataFrame, side: str, other: str, mass: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """(other, m, x) of vectors (side, x), without the known first one, and the products of what is left."""
        moved = table.join(vectors.select(side, "x"), side).groupBy(other).agg(F.array(*[F.sum(F.col("w") * F.col("x")[i]) for i in axes]).alias("x")).join(mass, other)
        moved = staged(moved, "ca-vectors")
        known = moved.agg(*[F.sum(F.sqrt("m") * F.col("x")[i]) for i in axes]).first()
        clean = moved.select(other, "m", F.array(*[F.col("x")[i] - F.sqrt("m") * float(known[i]) for i in axes]).alias("x"))
        pairs = [(i, j) for i in axes for j in range(i, q)]
        got = clean.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).first()
        gram = np.zeros((q, q))
        for (i, j), v in zip(pairs, got, strict=True):
            gram[i, j] = gram[j, i] = v
        return clean, gram

    def turned(vectors: DataFrame, by: np.ndarray) -> DataFrame:
        return vectors.withColumn("x", F.array(*[sum((F.col("x")[i] * float(by[i, j]) for i in axes), F.lit(0.0)) for j in range(by.shape[1])]))

    def whitened(gram: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(gram)
        keep = np.maximum(values, 1e-14 * max(values.max(), 1e-300))
        return vectors / np.sqrt(keep)

    start = cols.select("col", "m", F.array(*[F.xxhash64("col", F.lit(i)) / float(2**63) for i in axes]).alias("x"))
    on_rows, gram = carried(start, "col", "row", rows)
    last = np.zeros(q)
    for _ in range(rounds):
        on_cols, gram = carried(turned(on_rows, whitened(gram)), "row", "col", cols)
        on_rows, gram = carried(turned(on_cols, whitened(gram)), "col", "row", rows)
        values = np.sort(np.linalg.eigvalsh(gram))[::-1]
        if np.abs(values - last)[:ncp].max() <= tol * max(values[0], 1e-300):
            break
        last = values
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][: min(ncp, q)]
    values = np.maximum(values[order], 0)
    # rows: products of the table with orthonormal vectors, so their length is the singular value
    on_rows = staged(turned(on_rows, vectors[:, order]), "ca-rows")
    q = len(order)
    axes = range(q)
    # carried back, vectors on the columns have the eigenvalue as their length
    back = table.join(on_rows.select("row", "x"), "row").groupBy("col").agg(F.array(*[F.sum(F.col("w") * F.col("x")[i]) for i in axes]).alias("x")).join(cols, "col")
    top = on_rows.agg(*[F.max_by(F.sign(F.col("x")[i]), F.struct(F.round(F.abs(F.col("x")[i] / F.sqrt("m")), 9), "row")) for i in axes]).first()
    far = {side: table.groupBy(side).agg((F.sum(F.col("p") ** 2 / F.col(opposite)) / F.first(own) ** 2 - 1).alias("far")) for side, own, opposite in (("row", "a", "b"), ("col", "b", "a"))}
    parts = []
    for side, data, scale in (("row", on_rows, np.ones(q)), ("col", back, np.sqrt(values))):
        x = F.array(*[F.struct(F.lit(i + 1).alias("axis"), (F.col("x")[i] * float(top[i] or 1.0) / max(float(scale[i]), 1e-150)).alias("x"), F.lit(float(values[i])).alias("value")) for i in axes])
        long = data.join(far[side], side).select(F.lit(side).alias("side"), F.col(side).alias("category"), "m", "far", F.explode(x).alias("v"))
        coord = F.col("v.x") / F.sqrt("m")
        parts.append(long.select("side", "category", "v.axis", coord.alias("coord"), F.coalesce(F.try_divide(F.col("v.x") ** 2 * 100, F.col("v.value")), F.lit(0.0)).alias("contribution"), F.coalesce(F.try_divide(coord**2, F.greatest("far", F.lit(1e-300))), F.lit(0.0)).alias("cos2")))
    share = values * 100 / max(total, 1e-300)
    eig = spark.createDataFrame([(i + 1, float(v), float(share[i]), float(share[: i + 1].sum())) for i, v in enumerate(values)], "axis int, eigenvalue double, percent double, cumulative double")
    return eig, parts[0].unionByName(parts[1])


def _ca(spark, t: np.ndarray, rows: list[str], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    p = t / t.sum()
    a, b = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(a, b)) / np.sqrt(np.outer(a, b)), full_matrices=False)
    k = min(t.shape) - 1
    sign = np.sign(u[np.abs(u[:, :k]).argmax(0), np.arange(k)])
    out = []
    for side, names, mass, vec in (("row", rows, a, u[:, :k] * sign), ("col", cols, b, vt[:k].T * sign)):
        coord = vec * s[:k] / np.sqrt(mass)[:, None]
        norm = np.maximum((coord**2).sum(1, keepdims=True), 1e-300)
        out += [(side, str(names[i]), x + 1, float(coord[i, x]), float(vec[i, x] ** 2 * 100), float(coord[i, x] ** 2 / norm[i, 0])) for i in range(len(names)) for x in range(k)]
    return eigen_table(spark, s[:k] ** 2), spark.createDataFrame(out, "side string, category string, axis int, coord double, contribution double, cos2 double")


def ca_text(dtm: DataFrame, ncp: int = 2, most_terms: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Correspondence analysis of (doc_id, term, tf): eigenvalues, (term, axis, coord, contribution), (doc_id, dim_1..).

    The term by term matrix is summed from pairs of terms of the same document, in Arrow batches of whole
    documents. With more terms than most_terms the first axes come from products with blocks of vectors (_first_axes), with more than
    MOST_TERMS from ca_sparse, which holds no vector of terms; the table of eigenvalues then has ncp of them.
    """
    spark = dtm.sparkSession
    many = dtm.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(MOST_TERMS + 1).toPandas()
    if most_terms < len(many) <= MOST_TERMS:
        return _first_axes(dtm, many, ncp)
    terms = many
    if len(terms) > most_terms:
        eig, found = ca_sparse(dtm.select(F.col("doc_id").cast("string").alias("row"), F.col("term").alias("col"), F.col("tf").alias("n")), ncp)
        scores = found.where("side = 'row'").groupBy(F.col("category").cast(dict(dtm.dtypes)["doc_id"]).alias("doc_id")).agg(*[F.max(F.when(F.col("axis") == x + 1, F.col("coord"))).alias(f"dim_{x + 1}") for x in range(ncp)])
        return eig, found.where("side = 'col'").select(F.col("category").alias("term"), "axis", "coord", "contribution"), scores
    total = float(terms.n.sum())
    v = len(terms)
    held = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms.term)})
    docs = dtm.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((v, v))
        for pdf in batches:
            m = np.zeros((len(pdf), v))
            for k, (ts, fs) in enumerate(zip(pdf.terms, pdf.tfs, strict=True)):
                m[k, [held.value[t] for t in ts]] = np.asarray(fs, float)
            m /= np.sqrt(m.sum(1, keepdims=True))
            out += m.T @ m
        i, j = np.nonzero(out)
        yield pd.DataFrame({"i": i, "j": j, "v": out[i, j]})

    g = np.zeros((v, v))
    for r in docs.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        g[r.i, r.j] = r.v
    mass = terms.n.to_numpy(float) / total
    s = g / total / np.sqrt(np.outer(mass, mass)) - np.sqrt(np.outer(mass, mass))
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), signed(vectors[:, order[:ncp]])
    coord = vectors * np.sqrt(values[:ncp]) / np.sqrt(mass)[:, None]
    of_terms = spark.createDataFrame([(t, x + 1, float(coord[i, x]), float(vectors[i, x] ** 2 * 100)) for i, t in enumerate(terms.term) for x in range(ncp)], "term string, axis int, coord double, contribution double")
    weights = spark.createDataFrame([(t, *[float(c) for c in vectors[i] / np.sqrt(mass[i])]) for i, t in enumerate(terms.term)], "term string, " + ", ".join(f"w{x + 1} double" for x in range(ncp)))
    of_docs = dtm.join(F.broadcast(weights), "term").groupBy("doc_id").agg(*[(F.sum(F.col("tf") * F.col(f"w{x + 1}")) / F.sum("tf")).alias(f"dim_{x + 1}") for x in range(ncp)])
    return eigen_table(spark, values), of_terms, of_docs


def _first_axes(dtm: DataFrame, terms: pd.DataFrame, ncp: int, extra: int = 6, rounds: int = 150, tol: float = 1e-9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ca_text by block Krylov iteration: a round is one scan of the documents, which multiplies a block of vectors on the terms.

    The driver holds up to BLOCKS blocks of vectors (terms by ncp + extra), fewer if they pass HELD numbers, and solves the small matrix of their
    products; a full basis starts anew from its best vectors. It ends when the residuals of the first ncp axes are below tol. Signs make the document
    coordinate of largest size positive.
    """
    spark, v, count = dtm.sparkSession, len(terms), terms.n.to_numpy(float)
    mass = count / count.sum()
    root, known, q = np.sqrt(count)[:, None], np.sqrt(mass)[:, None], ncp + extra if v > 3 * (ncp + extra) else v - 1  # few terms: all axes at once
    ids = spark.createDataFrame([(t, i, n) for i, (t, n) in enumerate(zip(terms.term, count.tolist(), strict=True))], "term string, i int, n double")
    cells = dtm.join(F.broadcast(ids), "term").select("doc_id", F.struct("i", F.col("tf").cast("double").alias("tf")).alias("x"), (F.col("tf") * F.col("tf") / F.col("n")).alias("square"))
    docs = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x"), (F.sum("square") / F.sum("x.tf")).alias("square"))
    docs = staged(docs.select("doc_id", F.col("x.i").alias("i"), F.col("x.tf").alias("tf"), "square"), "ca-documents")
    total = docs.agg(F.sum("square")).first()[0]  # of squared cells of the scaled table

    def product(x: np.ndarray) -> np.ndarray:
        """The scaled table, transposed, times the table times x, without the known axis."""
        width = x.shape[1]
        held = spark.sparkContext.broadcast(np.ascontiguousarray((x / root).T))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = held.value
            out = np.zeros_like(x)
            for batch in batches:
                for _, _, size, i, tf in _cells(batch):
                    for j, y in enumerate(_rows(size, i, tf, x)):
                        out[j] += np.bincount(i, tf * np.repeat(y, size), len(out[j]))
            for at in range(0, out.shape[1], TERMS_AT_ONCE):
                yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "y": pa.array([out[:, at : at + TERMS_AT_ONCE].T.ravel()], pa.list_(pa.float64()))})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "y": [np.sum(np.stack(pdf.y.tolist()), 0)]})

        parts = docs.select("i", "tf").mapInArrow(run, "part int, y array<double>").groupBy("part").applyInPandas(added, "part int, y array<double>")
        y = np.concatenate([r.y for r in sorted(parts.collect(), key=lambda r: r.part)]).reshape(v, width) / root
        held.unpersist()
        return y - known @ (known.T @ x)

    most = max(3, min(BLOCKS, HELD // (2 * v * q)))
    basis, images = (np.empty((v, min(most * q, max(v, q))), order="F") for _ in range(2))

    def apart(x: np.ndarray, others: np.ndarray) -> np.ndarray:
        """x made orthonormal and orthogonal to the known axis and others."""
        for _ in range(2):
            for o in (known, others):
                x = x - o @ (o.T @ x)
            x = np.linalg.qr(x)[0]
        return x

    x, width = apart(np.random.default_rng(1).standard_normal((v, q)), basis[:, :0]), 0
    for _ in range(rounds):
        image = product(x)
        basis[:, width : width + q], images[:, width : width + q] = x, image
        width += q
        b, a = basis[:, :width], images[:, :width]
        small = b.T @ a
        values, inner = np.linalg.eigh((small + small.T) / 2)
        inner = inner[:, ::-1][:, :q]  # the largest first
        values, vectors = np.maximum(values[::-1][:q], 0), b @ inner
        left = np.linalg.norm(a @ inner - vectors * values, axis=0)[:ncp]
        if left.max() <= tol * max(values[0], 1e-300) or q == v - 1:
            break
        if width >= most * q or width + q >= v:
            image = a @ inner
            basis[:, :q], images[:, :q], width = vectors, image, q
        x = apart(image, basis[:, :width])
    values, vectors = values[:ncp], vectors[:, :ncp]
    scaled, names = vectors / np.sqrt(mass)[:, None], [f"dim_{k + 1}" for k in range(vectors.shape[1])]
    weights = spark.sparkContext.broadcast(np.ascontiguousarray(scaled.T))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, size, i, tf in _cells(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, _rows(size, i, tf, weights.value))], ["doc_id", *names])

    scores = staged(docs.select("doc_id", "i", "tf").mapInArrow(scored, ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *[f"{n} double" for n in names]])), "ca-scores")
    sign = [float(s or 1.0) for s in scores.agg(*[F.max_by(F.sign(n), F.struct(F.round(F.abs(n), 9), F.col("doc_id").cast("string"))) for n in names]).first()]
    coord = scaled * np.sqrt(values) * sign
    of_terms = spark.createDataFrame([(t, k + 1, float(coord[i, k]), float(vectors[i, k] ** 2 * 100)) for i, t in enumerate(terms.term) for k in range(len(names))], "term string, axis int, coord double, contribution double")
    share = values * 100 / max(total - 1, 1e-300)
    eig = spark.createDataFrame([(i + 1, float(x), float(share[i]), float(share[: i + 1].sum())) for i, x in enumerate(values)], "axis int, eigenvalue double, percent double, cumulative double")
    return eig, of_terms, scores.select("doc_id", *[(F.col(n) * s).alias(n) for n, s in zip(names, sign, strict=True)])


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, end, terms of each, terms, counts) of groups of documents with about CELLS_AT_ONCE cells."""
    i, tf = (batch.column(c).flatten().to_numpy() for c in ("i", "tf"))
    start = batch.column("i").offsets.to_numpy()
    start = start - start[0]
    edges = np.flatnonzero(np.diff(start[:-1] // CELLS_AT_ONCE)) + 1
    for a, b in zip([0, *edges], [*edges, len(start) - 1], strict=True):
        if a < b:
            yield int(a), int(b), np.diff(start[a : b + 1]), i[start[a] : start[b]], tf[start[a] : start[b]]


def _rows(size: np.ndarray, i: np.ndarray, tf: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
    """Of each row of x, a number by term: its mean over the terms of each document."""
    start = np.cumsum(size) - size
    n = np.add.reduceat(tf, start)
    for y in x:
        yield np.add.reduceat(tf * y[i], start) / n
