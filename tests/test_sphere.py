"""Hexagons on the sphere against geometry in space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import sphere


def vector(lat, lng):
    a, b = np.radians(lat), np.radians(lng)
    return np.array([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def holds(corners, p, slack=1e-12):
    c = [vector(k.lat, k.lng) for k in corners]
    return all(np.cross(a, b) @ p >= -slack for a, b in zip(c, c[1:] + c[:1], strict=True))


def size(corners):
    """Area on the unit sphere, by triangles from the first corner."""
    c = [vector(k.lat, k.lng) for k in corners]
    tri = lambda a, b, d: 2 * np.arctan2(abs(np.dot(a, np.cross(b, d))), 1 + a @ b + b @ d + d @ a)
    return sum(tri(c[0], c[k], c[k + 1]) for k in range(1, 5))


def test_faces_are_an_icosahedron():
    c, u, v = (sphere.FACES[:, k] for k in range(3))
    assert len(c) == 20 and np.allclose(c.sum(0), 0) and np.allclose([np.linalg.det(f) for f in sphere.FACES], 1)
    assert np.allclose(np.sort(c @ c.T, 1)[:, -4:-1], np.sqrt(5) / 3) and np.allclose((c * u).sum(1), 0) and np.allclose((u * v).sum(1), 0)


@pytest.mark.parametrize("resolution", [0, 2, 6, 7])
def test_points_lie_in_their_cells(spark, resolution):
    rng = np.random.default_rng(resolution)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    rows = [(float(np.degrees(np.arcsin(z))), float(np.degrees(np.arctan2(y, x)))) for x, y, z in p] + [(90.0, 0.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0), (40.5, -75.0)]
    d = spark.createDataFrame(rows, "lat double, lng double").withColumn("cell", sphere.sphere_cell(F.col("lat"), F.col("lng"), resolution))
    got = d.select("*", sphere.sphere_boundary(F.col("cell"), resolution).alias("b"), sphere.sphere_centre(F.col("cell"), resolution).alias("c")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert holds(r.b, vector(r.lat, r.lng)) and holds(r.b, vector(r.c.lat, r.c.lng))
    if resolution >= 6:  # smaller cells have one scale all over
        share = np.array([size(r.b) for r in got]) / (4 * np.pi / (120 * 7**resolution))
        assert share.min() > 0.60 and share.max() < 1.21
    near = {r.cell for r in got if r.lat == 0.0}
    assert len(near) == 1


def test_parents_hold_the_centres_of_their_children(spark):
    d = spark.createDataFrame([(f"6_{f}_{q}_{t}",) for f in (0, 7, 19) for q, t in [(0, 0), (5, -3), (-11, 4), (100, 33), (-64, -1)]], "cell string")
    d = d.select("cell", sphere.sphere_boundary(F.col("cell"), 6).alias("b"), F.explode(sphere.sphere_children(F.col("cell"))).alias("child"))
    got = d.select("*", sphere.sphere_parent(F.col("child")).alias("parent"), sphere.sphere_centre(F.col("child"), 7).alias("c")).collect()
    assert len(got) == len({r.child for r in got}) == 105 and all(r.parent == r.cell and holds(r.b, vector(r.c.lat, r.c.lng)) for r in got)
    first = d.groupBy("cell", "b").agg(F.first("child").alias("child")).select(sphere.sphere_centre(F.col("cell"), 6).alias("a"), sphere.sphere_centre(F.col("child"), 7).alias("z")).collect()
    assert all(np.allclose(r.a, r.z) for r in first)


def test_places_without_coordinates(spark):
    d = spark.createDataFrame([(None, 1.0), (1.0, None), (None, None)], "lat double, lng double")
    assert [r[0] for r in d.select(sphere.sphere_cell(F.col("lat"), F.col("lng"))).collect()] == [None] * 3
    assert spark.range(1).select(sphere.sphere_parent(F.lit("0_3_0_0"))).first()[0] is None


def test_boundaries_of_the_table(spark, sf):
    from tarmac.plans import registry

    got = registry.QUERIES["boundaries_on_sphere"](spark, sf)
    cells = {r.cell for r in registry.QUERIES["cells_on_sphere"](spark, sf).collect()}
    assert got.count() == 6 * len(cells) and {r.cell for r in got.select("cell").distinct().collect()} == cells
