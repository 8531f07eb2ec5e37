"""Distances of points to triangles and contact regions against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrain.operators import contact as C
from kinegrain.operators import volume as V

TRI = "entity long, part long, " + ", ".join(f"{n} double" for n in V.COORDINATES)
POINT = "entity long, part long, idx long, x double, y double, z double"


def closest(p, a, b, c):
    """Distance by the region of the plane that the point is in."""
    ab, ac, ap = b - a, c - a, p - a
    d1, d2 = ab @ ap, ac @ ap
    if d1 <= 0 and d2 <= 0:
        return np.linalg.norm(p - a)
    d3, d4 = ab @ (p - b), ac @ (p - b)
    if d3 >= 0 and d4 <= d3:
        return np.linalg.norm(p - b)
    vc = d1 * d4 - d3 * d2
    if vc <= 0 and d1 >= 0 and d3 <= 0:
        return np.linalg.norm(p - a - d1 / (d1 - d3) * ab)
    d5, d6 = ab @ (p - c), ac @ (p - c)
    if d6 >= 0 and d5 <= d6:
        return np.linalg.norm(p - c)
    vb = d5 * d2 - d1 * d6
    if vb <= 0 and d2 >= 0 and d6 <= 0:
        return np.linalg.norm(p - a - d2 / (d2 - d6) * ac)
    va = d3 * d6 - d5 * d4
    if va <= 0 and d4 - d3 >= 0 and d5 - d6 >= 0:
        return np.linalg.norm(p - b - (d4 - d3) / (d4 - d3 + d5 - d6) * (c - b))
    n = np.cross(ab, ac)
    return abs(ap @ n) / np.linalg.norm(n)


def test_near_surfaces(spark):
    rng = np.random.default_rng(2)
    tri = [(e, part, *map(float, rng.normal(0, 1, 3).repeat(3) * 0 + rng.normal(0, 0.4, 9) + np.tile(rng.normal(0, 1, 3), 3))) for e in (1, 2) for part in (1, 2, 3) for _ in range(15)]
    tri += [(1, 4, *[0.5] * 9), (1, 4, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0)]  # a point and a line
    points = [(e, part, k, *map(float, rng.normal(0, 1, 3))) for e in (1, 2) for part in (1, 2, 9) for k in range(25)]
    for reach in (0.05, 0.6, 30.0):
        got = {(r.entity, r.part, r.idx, r.other): r.distance for r in C.near_surfaces(spark.createDataFrame(points, POINT), spark.createDataFrame(tri, TRI), reach).collect()}
        want = {}
        for e, part, k, *p in points:
            for f, other, *t in tri:
                if e == f and part != other:
                    a, b, c = np.array(t).reshape(3, 3)
                    if other == 4:
                        ends = [(a, b), (b, c), (a, c)]
                        d = min(np.linalg.norm(np.array(p) - x - np.clip(((np.array(p) - x) @ (y - x)) / max((y - x) @ (y - x), 1e-300), 0, 1) * (y - x)) for x, y in ends)
                    else:
                        d = closest(np.array(p), a, b, c)
                    key = (e, part, k, other)
                    want[key] = min(d, want.get(key, 1e9))
        want = {k: d for k, d in want.items() if d <= reach}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_regions(spark):
    square = [(1, 1, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 9.0, 0.0), (1, 1, 9.0, 0.0, 0.0, 9.0, 9.0, 0.0, 0.0, 9.0, 0.0)]
    heights = [0.005, 0.0095, 0.5, 0.52, 0.53, 0.55, 0.555, 0.56, 3.0, 7.0]
    points = [(1, 2, k, 3.0, 3.0, h) for k, h in enumerate(heights)] + [(1, 1, k, 1.0, 1.0, 0.0) for k in range(3)]
    tri, pts = spark.createDataFrame(square, TRI), spark.createDataFrame(points, POINT)
    assert [(r.part, r.relaxations, r.size) for r in C.contact_regions(pts, tri).collect()] == [(1, 55, 7)]
    assert [(r.relaxations, r.size) for r in C.contact_regions(pts, tri, least=2).collect()] == [(0, 2)]
    assert [(r.relaxations, r.size) for r in C.contact_regions(pts, tri, least=50).collect()] == [(700, 10)]
    assert [(r.relaxations, r.size) for r in C.contact_regions(pts, tri, least=9, most_steps=100).collect()] == [(100, 8)]
    assert C.contact_regions(pts.limit(0), tri).count() == 0
    best = C.best_neighbours(pts, tri, eps=0.53).collect()
    assert [(r.part, r.other, r.touching, r.share) for r in best] == [(2, 1, 4, 0.4)]


def test_error_points(spark):
    rows = [(1, r, c, r < 5, r < 5 and c < 5) for r, c in itertools.product(range(10), repeat=2)] + [(2, r, c, c == 0, c == 0) for r, c in itertools.product(range(6), repeat=2)]
    rows += [(3, r, 0, False, True) for r in range(4)] + [(4, 0, 0, True, True)]
    got = C.error_points(spark.createDataFrame(rows, "image int, row int, col int, gold boolean, mask boolean"), 40).collect()
    by = {i: [(r.row, r.col, r.label) for r in got if r.image == i] for i in (1, 2, 3, 4)}
    assert len(by[1]) == 40 and all(r < 5 <= c and label == 1 for r, c, label in by[1]) and len(set(by[1])) > 12
    assert len(by[2]) == 40 and all(c > 0 and label == 0 for _, c, label in by[2])
    assert {x[2] for x in by[3]} == {0} and by[4] == []
