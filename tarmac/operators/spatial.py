"""Cells, projections and densities of incident coordinates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres per degree, and the origin of the planar grid of cells.
KM_LNG, KM_LAT, LAT0, LNG0 = 111.32, 110.574, 40.5, -75.0


def _plane(lat: Column, lng: Column) -> tuple[Column, Column]:
    return (lng - LNG0) * KM_LNG * F.cos(F.radians(F.lit(LAT0))), (lat - LAT0) * KM_LAT


def nearest_axial(q: Column, r: Column) -> tuple[Column, Column]:
    """Axial coordinates (whole numbers, as doubles) of the hexagon that holds a place: of three rounded ones, the worst is made good."""
    s = -q - r
    rq, rr, rs = (F.floor(v + 0.5).cast("double") for v in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    return F.when(fix_q, -(rr + rs)).otherwise(rq), F.when(fix_q, rr).when(dr > ds, -(rq + rs)).otherwise(rr)


def hex_cell(lat: Column, lng: Column, size: float = 5.0) -> Column:
    """Axial coordinates q_r of the hexagon (of `size` km from centre to corner) that holds a point."""
    x, y = _plane(lat, lng)
    a, b = nearest_axial((F.sqrt(F.lit(3.0)) / 3 * x - y / 3) / size, (2.0 / 3 * y) / size)
    return F.concat(a.cast("bigint").cast("string"), F.lit("_"), b.cast("bigint").cast("string"))


def hex_boundary(cell: Column, size: float = 5.0) -> Column:
    """The six corners (lat, lng) of a cell."""
    q, r = (F.split(cell, "_")[i].cast("double") for i in (0, 1))
    x, y = size * (math.sqrt(3) * q + math.sqrt(3) / 2 * r), size * 1.5 * r
    corner = lambda k: F.struct(((y + size * math.sin(math.radians(60 * k - 30))) / KM_LAT + LAT0).alias("lat"), ((x + size * math.cos(math.radians(60 * k - 30))) / (KM_LNG * math.cos(math.radians(LAT0))) + LNG0).alias("lng"))
    return F.array(*[corner(k) for k in range(6)])


def utm(lat: Column, lng: Column, zone: int = 18) -> tuple[Column, Column]:
    """Easting and northing in km on WGS84, by the usual series."""
    a, f, k0 = 6378.137, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lng - F.lit(float(zone * 6 - 183)))
    n = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, big = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * lam
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    x = k0 * n * (big + (1 - t + c) * big**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * big**5 / 120) + 500
    y = k0 * (m + n * F.tan(phi) * (big**2 / 2 + (5 - t + 9 * c + 4 * c * c) * big**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * big**6 / 720))
    return x, y


def within(df: DataFrame, polygon: list[tuple[float, float]], x: str, y: str) -> DataFrame:
    """Rows whose point lies in the polygon: a box first, then ray casting; points on an edge may go either way."""
    p = np.asarray(polygon, float)
    px, py, qx, qy = p[:, 0], p[:, 1], np.roll(p[:, 0], -1), np.roll(p[:, 1], -1)
    held = df.sparkSession.sparkContext.broadcast((px, py, qx, qy))

    @F.pandas_udf("boolean")
    def inside(xs: pd.Series, ys: pd.Series) -> pd.Series:
        ax, ay, bx, by = held.value
        a, b = xs.to_numpy()[:, None], ys.to_numpy()[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = ((ay > b) != (by > b)) & (a < (bx - ax) * (b - ay) / (by - ay) + ax)
        return pd.Series(crosses.sum(1) % 2 == 1)

    box = F.col(x).between(float(px.min()), float(px.max())) & F.col(y).between(float(py.min()), float(py.max()))
    return df.where(box).where(inside(F.col(x).cast("double"), F.col(y).cast("double")))


def quadrats(df: DataFrame, x: str, y: str, nx: int = 4, ny: int = 4) -> DataFrame:
    """(ix, iy, n, intensity) of an nx by ny grid over the extent; empty quadrats included."""
    ext = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    w, h = (F.col("x1") - F.col("x0")) / nx, (F.col("y1") - F.col("y0")) / ny
    at = lambda c, lo, size, k: F.least(F.lit(k - 1), F.floor((F.col(c) - F.col(lo)) / size)).cast("int")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(ext))
    counts = rows.groupBy(at(x, "x0", w, nx).alias("ix"), at(y, "y0", h, ny).alias("iy")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    return grid.join(counts, ["ix", "iy"], "left").fillna(0, ["n"]).crossJoin(F.broadcast(ext)).select("ix", "iy", "n", (F.col("n") / (w * h)).alias("intensity"))


def intensity(df: DataFrame, mark: str, area: float) -> DataFrame:
    return df.where(F.col(mark).isNotNull()).groupBy(mark).agg(F.count("*").alias("n"), (F.count("*") / F.lit(float(area))).alias("intensity"))


def kde(df: DataFrame, x: str, y: str, sigma: float, step: float, by: str | None = None, reach: float = 3.0) -> DataFrame:
    """Gaussian density at the centres of a grid of `step`: (gx, gy, density), per level of `by`.

    Points are counted by grid cell first, so what is spread over neighbouring cells grows with the area,
    not with the points. The kernel ends at reach * sigma.
    """
    ids = [by] if by else []
    g = lambda c: F.floor(F.col(c) / step).cast("long")
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(g(x).alias("cx"), g(y).alias("cy"), *ids).agg(F.count("*").alias("n"))
    k = math.ceil(reach * sigma / step)
    offsets = [(i, j, math.exp(-((i * step) ** 2 + (j * step) ** 2) / (2 * sigma**2)) / (2 * math.pi * sigma**2)) for i in range(-k, k + 1) for j in range(-k, k + 1) if math.hypot(i, j) * step <= reach * sigma]
    spread = cells.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in offsets])))
    return spread.groupBy((F.col("cx") + F.col("o.i")).alias("gx"), (F.col("cy") + F.col("o.j")).alias("gy"), *ids).agg(F.sum(F.col("n") * F.col("o.w")).alias("density"))


def density_at(grid: DataFrame, places: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """places with the density of their grid cell; 0 outside. places is a short list."""
    at = places.withColumn("gx", F.floor(F.col(x) / step).cast("long")).withColumn("gy", F.floor(F.col(y) / step).cast("long"))
    near = grid.join(F.broadcast(at.select("gx", "gy").distinct()), ["gx", "gy"], "left_semi")
    return at.join(near, ["gx", "gy"], "left").fillna(0.0, ["density"]).drop("gx", "gy")

