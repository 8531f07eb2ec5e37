"""Vectors of three doubles as arrays, and the frames that they are moved between."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import lit

EPS = 1e-12


def vec(x, y, z) -> Column:
    as_col = lambda v: v.cast("double") if isinstance(v, Column) else lit(v)
    return F.array(as_col(x), as_col(y), as_col(z))


def add(a: Column, b: Column) -> Column:
    return F.array(*[a[k] + b[k] for k in range(3)])


def sub(a: Column, b: Column) -> Column:
    return F.array(*[a[k] - b[k] for k in range(3)])


def scale(a: Column, s) -> Column:
    return F.array(*[a[k] * s for k in range(3)])


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; null for a vector shorter than EPS or not of three numbers."""
    n = length(a)
    return F.when((F.size(a) == 3) & (n > EPS), F.array(*[F.try_divide(a[k], n) for k in range(3)]))


def _size(a: Column) -> Column:
    """Length, or null if it is too short for a direction. Formulas divide by it once, so that no unit vector is built and expressions stay small."""
    n = length(a)
    return F.when(n > EPS, n)


def spherical(theta: Column, phi: Column) -> Column:
    """Unit vector of polar angle theta and azimuth phi, in degrees."""
    t, p = F.radians(theta), F.radians(phi)
    return F.array(F.sin(t) * F.cos(p), F.sin(t) * F.sin(p), F.cos(t))


def axis_vector(v: Column) -> Column:
    """Unit vector of a variant that is {theta, phi} or a list of three numbers."""
    from .numeric import as_float, numeric_vector

    get = lambda k: as_float(F.try_variant_get(v, f"$.{k}", "variant"))
    return F.coalesce(unit(numeric_vector(v, 3)), unit(spherical(get("theta"), get("phi"))))


def axis_angle(a: Column, b: Column) -> Column:
    """Degrees between two lines, whatever their sense."""
    return F.degrees(F.acos(F.least(lit(1), F.abs(dot(a, b) / (_size(a) * _size(b))))))


def vector_angle(a: Column, b: Column) -> Column:
    """Degrees between two directions; null for zero vectors."""
    return F.degrees(F.acos(F.greatest(lit(-1), F.least(lit(1), dot(a, b) / (_size(a) * _size(b))))))


def point_to_line(p: Column, q: Column, axis: Column) -> Column:
    """Distance of p from the line through q."""
    return length(cross(sub(p, q), axis)) / _size(axis)


def line_distance(p: Column, a: Column, q: Column, b: Column, eps: float = 1e-6) -> Column:
    """Distance of two lines; that of a point from a line if they are parallel."""
    n, d = cross(a, b), sub(q, p)
    skew = F.abs(F.try_divide(dot(d, n), length(n)))
    return F.when(length(n) < eps * _size(a) * _size(b), length(cross(d, a)) / _size(a)).otherwise(skew)


def project_pivot(q: Column, axis: Column, centre: Column) -> Column:
    """The point of the line through q that is nearest to centre."""
    return add(q, scale(axis, dot(sub(centre, q), axis) / (_size(axis) * _size(axis))))


def rodrigues(v: Column, axis: Column, angle: Column) -> Column:
    """v turned about axis by angle radians."""
    n = _size(axis)
    c, s = F.cos(angle), F.sin(angle)
    side, along = cross(axis, v), dot(axis, v) * (1 - c) / (n * n)
    return F.array(*[v[k] * c + side[k] * (s / n) + axis[k] * along for k in range(3)])


def rotate_about(p: Column, centre: Column, axis: str, degrees: Column) -> Column:
    """p turned about a coordinate axis through centre."""
    k = vec(*[float(axis == a) for a in "xyz"])
    return add(rodrigues(sub(p, centre), k, F.radians(degrees)), centre)


def source_to_model(p: Column, centre: Column, s: Column, min_bound: Column) -> Column:
    return sub(scale(sub(p, centre), 1 / s), min_bound)


def model_to_source(p: Column, centre: Column, s: Column, min_bound: Column) -> Column:
    return add(scale(add(p, min_bound), s), centre)


def theta_phi(v: Column) -> Column:
    """Whole degrees (theta, phi) of a line, turned so that it points up; phi in [0, 360)."""
    down = (v[2] < 0) | ((v[2] == 0) & ((v[1] < 0) | ((v[1] == 0) & (v[0] < 0))))
    s = F.when(down, lit(-1)).otherwise(lit(1))
    theta = F.degrees(F.acos(F.greatest(lit(-1), F.least(lit(1), s * v[2] / _size(v)))))
    phi = F.pmod(F.degrees(F.atan2(s * v[1], s * v[0])), lit(360))
    return F.struct(F.bround(theta).cast("int").alias("theta"), F.pmod(F.bround(phi).cast("int"), F.lit(360)).alias("phi"))


def plane_angle(n1: Column, n2: Column) -> Column:
    """Degrees between two planes."""
    return axis_angle(n1, n2)


def plane_offset(p: Column, normal: Column, d: Column) -> Column:
    """Distance of p from the plane normal . x + d = 0."""
    return F.abs(F.try_divide(dot(p, normal) + d, length(normal)))


def plane_rotations(normal: Column, in_plane: Column, steps: int = 6) -> list[Column]:
    """The normal, directions in the plane by equal turns, and the coordinate axes."""
    turns = [rodrigues(in_plane, normal, lit(k * math.pi / steps)) for k in range(steps)]
    return [unit(normal), *map(unit, turns), vec(1, 0, 0), vec(0, 1, 0), vec(0, 0, 1)]


def world_to_body(p: Column, t: Column, axis: Column, angle: Column) -> Column:
    """Coordinates of p in a body that was moved by t and turned about axis."""
    return rodrigues(sub(p, t), axis, -angle)
