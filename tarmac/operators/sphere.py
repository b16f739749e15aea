"""Hexagons on the sphere: lattices on the faces of an icosahedron, each resolution seven times finer than the last.

A point belongs to the face whose centre is nearest and is projected on its plane from the sphere's centre. There, cells of
resolution r are the hexagons around the points RHO * (q + t * zeta) / alpha**r, with zeta = exp(i pi / 3) and alpha = 2 +
zeta, of norm 7; so each cell's centre is also one of the next resolution, and six more centres lie inside it. The earth has
about 120 * 7**r cells: 36 km2 on average at 6, 5.2 at 7. Toward a face's corners the plane is stretched, so whole cells have
0.60 to 1.21 times the mean area. A cell that reaches over the edge of a face ends there.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.operators.spatial import nearest_axial

GOLDEN = (1 + math.sqrt(5)) / 2
#: Radius of the circle in a face, on the plane that touches the unit sphere: the spacing of resolution 0.
RHO = 1 / GOLDEN**2
ALPHA = complex(2.5, math.sqrt(3) / 2)


def _faces() -> np.ndarray:
    """(20, 3, 3): of each face the unit vector to its centre and two axes of its plane, the first toward a corner."""
    corners = [np.roll([0.0, a, b * GOLDEN], k) for k in range(3) for a in (-1, 1) for b in (-1, 1)]
    found = []
    for trio in combinations(corners, 3):
        if all(abs(np.linalg.norm(a - b) - 2) < 1e-9 for a, b in combinations(trio, 2)):
            centre = sum(trio) / np.linalg.norm(sum(trio))
            u = trio[0] - (trio[0] @ centre) * centre
            u /= np.linalg.norm(u)
            found.append((centre, u, np.cross(centre, u)))
    return np.array(found)


FACES = _faces()


def sphere_cell(lat: Column, lng: Column, resolution: int = 7) -> Column:
    """resolution_face_q_t of the cell that holds a point given in degrees; null where a coordinate is."""
    a, b = F.radians(lat.cast("double")), F.radians(lng.cast("double"))
    point = F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))
    turn = ALPHA**resolution / RHO

    def dot(p: Column, v: np.ndarray) -> Column:
        return p["x"] * float(v[0]) + p["y"] * float(v[1]) + p["z"] * float(v[2])

    def on_face(p: Column) -> Column:
        return F.array_max(F.array(*[F.struct(dot(p, c).alias("near"), F.lit(-f).alias("face"), dot(p, u).alias("u"), dot(p, v).alias("v")) for f, (c, u, v) in enumerate(FACES)]))

    def axial(s: Column) -> Column:
        x, y = s["u"] / s["near"], s["v"] / s["near"]
        t = (x * turn.imag + y * turn.real) * (2 / math.sqrt(3))
        return F.struct((-s["face"]).alias("face"), (x * turn.real - y * turn.imag - t / 2).alias("q"), t.alias("t"))

    def name(s: Column) -> Column:
        return _id(F.lit(resolution), s["face"], *nearest_axial(s["q"], s["t"]))

    one = F.array(point)  # each step is evaluated once for all that reads it
    for step in (on_face, axial, name):
        one = F.transform(one, step)
    return one[0]


def _id(resolution: Column, face: Column, q: Column, t: Column) -> Column:
    return F.concat(*[x for c in (resolution, face, q, t) for x in (F.lit("_"), c.cast("bigint").cast("string"))][1:])


def _parts(cell: Column) -> list[Column]:
    return [F.split(cell, "_")[i].cast("bigint") for i in range(4)]


def sphere_parent(cell: Column) -> Column:
    """The cell of the next coarser resolution on the same face that holds the centre of `cell`; null at resolution 0."""
    r, face, q, t = _parts(cell)
    return F.when(r > 0, _id(r - 1, face, *nearest_axial((3 * q + t) / 7.0, (2 * t - q) / 7.0)))


def sphere_children(cell: Column) -> Column:
    """The seven cells whose parent is `cell`, its centre's first."""
    r, face, q, t = _parts(cell)
    return F.array(*[_id(r + 1, face, 2 * q - t + a, q + 3 * t + b) for a, b in [(0, 0), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]])


def _places(cell: Column, resolution: int, offsets: list[tuple[float, float]]) -> Column:
    """(lat, lng) of places in the plane of a cell's face, given by axial offsets from its centre."""
    _, face, q, t = _parts(cell)
    scale = RHO / ALPHA**resolution
    axes = F.array(*[F.array(*[F.lit(float(x)) for x in f.ravel()]) for f in FACES])[face.cast("int")]

    def place(a: float, b: float) -> Column:
        re, im = q + a + (t + b) / 2, (t + b) * (math.sqrt(3) / 2)
        x, y = re * scale.real - im * scale.imag, re * scale.imag + im * scale.real
        p, r, s = (axes[k] + x * axes[3 + k] + y * axes[6 + k] for k in range(3))
        return F.struct(F.degrees(F.atan2(s, F.sqrt(p * p + r * r))).alias("lat"), F.degrees(F.atan2(r, p)).alias("lng"))

    return F.array(*[place(a, b) for a, b in offsets])


def sphere_centre(cell: Column, resolution: int = 7) -> Column:
    """(lat, lng) of the centre of a cell of the given resolution, whether or not its face reaches so far."""
    return _places(cell, resolution, [(0.0, 0.0)])[0]


def sphere_boundary(cell: Column, resolution: int = 7) -> Column:
    """The six corners (lat, lng) of a cell of the given resolution, in turn; where a face ends inside, of the whole hexagon."""
    return _places(cell, resolution, [(a / 3, b / 3) for a, b in [(1, 1), (-1, 2), (-2, 1), (-1, -1), (1, -2), (2, -1)]])
