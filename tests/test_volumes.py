"""Part volumes: hulls and cells against brute force, and the bounds of what is measured."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrain.operators import volume as V
from kinegrain.operators.validation import validate_objects
from kinegrain.plans.q_volumes import BOX, TETRAHEDRON

KEYS = ["part"]
SCHEMA = "part string, " + ", ".join(f"{n} double" for n in V.COORDINATES)


def rows_of(part, corners, faces):
    return [(part, *[float(v) for k in f for v in corners[k]]) for f in faces]


def box(lo, hi):
    return {k: tuple((lo, hi)[(k >> i) & 1][i] for i in range(3)) for k in range(8)}


def brute_hull(p):
    """Volume of points in general position: the faces are the triples with all other points on one side."""
    total, mid = 0.0, p.mean(axis=0)
    for i, j, k in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        side = (p - p[i]) @ n
        side = np.delete(side, [i, j, k])
        if (side > 0).all() or (side < 0).all():
            total += abs(np.dot(p[i] - mid, np.cross(p[j] - mid, p[k] - mid))) / 6
    return total


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 14), st.integers(0, 10**6))
def test_hull_against_all_triples(n, seed):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    assert V.hull_volume(p) == pytest.approx(brute_hull(p), rel=1e-9)
    corners, faces = V.convex_hull(p)
    assert len(faces) == 2 * len(corners) - 4
    assert V.hull_volume(p[corners]) == pytest.approx(V.hull_volume(p), rel=1e-9)


def test_hull_of_grids_planes_and_lines():
    grid = np.array(list(itertools.product(range(5), repeat=3)), float)
    assert V.hull_volume(grid) == pytest.approx(64) and V.hull_volume(grid * [1, 1, 0]) == 0
    plane = V.convex_hull(grid * [1, 1, 0])[0]
    assert {tuple(x) for x in (grid * [1, 1, 0])[plane]} == {(0, 0, 0), (0, 4, 0), (4, 0, 0), (4, 4, 0)}
    assert len(V.convex_hull(grid * [1, 0, 0])[0]) == 2 and len(V.convex_hull(grid * 0 + 3)[0]) == 1
    ball = np.random.default_rng(1).normal(size=(20_000, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    assert V.hull_volume(ball) == pytest.approx(4 / 3 * np.pi, rel=2e-3)


def test_hulls_of_chunks(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(-1, 1, (3000, 3)), list(itertools.product((-1, 1), repeat=3))])
    rows = [("a", *map(float, x)) for x in p] + [("flat", float(i), float(i % 7), 0.0) for i in range(50)] + [("a", None, 1.0, 1.0)]
    got = {r.part: r.volume for r in V.hull_volumes(spark.createDataFrame(rows, "part string, x double, y double, z double"), KEYS, chunk=200).collect()}
    assert got == {"a": pytest.approx(8), "flat": 0}


def test_cells_of_turned_boxes_holes_and_bounds(spark):
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(3, 3)))[0]
    turned = {k: tuple(turn @ v) for k, v in box((0, 0, 0), (3, 2, 1)).items()}
    outer, inner = box((0.01, 0.02, 0.03), (2.01, 2.02, 2.03)), box((0.51, 0.52, 0.53), (1.51, 1.52, 1.53))
    rows = rows_of("turned", turned, BOX) + rows_of("hollow", outer, BOX) + rows_of("hollow", inner, [f[::-1] for f in BOX])
    rows += rows_of("open", outer, BOX[:-2]) + rows_of("point", {k: (1, 1, 1) for k in range(8)}, TETRAHEDRON)
    tri = spark.createDataFrame(rows, SCHEMA)
    got = {r.part: r for r in V.voxel_volumes(tri, KEYS, resolution=64).collect()}
    assert got["turned"].solid_cells * got["turned"].pitch ** 3 == pytest.approx(6, rel=0.02) and got["turned"].open_columns == 0
    assert got["hollow"].solid_cells * got["hollow"].pitch ** 3 == pytest.approx(7, rel=0.02)
    assert got["open"].open_columns > 0 and got["point"].error == "flat" and got["point"].volume is None
    assert all(r.filled_cells >= max(r.solid_cells, r.surface_cells) for r in got.values() if r.error is None)
    signed = {r.part: r.volume for r in V.mesh_volumes(tri, KEYS).collect()}
    assert abs(signed["turned"]) == pytest.approx(6) and signed["hollow"] == pytest.approx(7)
    drawn = {r.part: r.volume for r in V.sampled_volumes(tri, KEYS, samples=4000).collect()}
    assert drawn["turned"] == pytest.approx(6, rel=0.1) and drawn["hollow"] == pytest.approx(7, rel=0.05)
    fine = {r.part: r for r in V.voxel_volumes(tri, KEYS, resolution=64, most_points=200_000).collect()}
    assert fine["hollow"].error == "too fine" and fine["hollow"].filled_cells is None and fine["turned"].filled_cells == got["turned"].filled_cells
    assert V.voxel_volumes(tri.limit(0), KEYS).count() == 0


def test_a_part_too_fine_is_an_error_of_its_object(spark):
    part = {"label": 1, "name": "leg", "material": "metal/steel", "density": "7.8 g/cm^3", "Young's Modulus (GPa)": 200.0, "Poisson's Ratio": 0.3, "friction_coefficient": 0.1, "Hardness (HV)": 150.0, "priority_rank": 1, "graspable": False}
    text = json.dumps({"dimension": "20*10*5 cm", "mass": "7.8 kg", "parts": [part]})
    a = spark.createDataFrame([(1, text), (2, text)], "entity long, text string")
    e = spark.createDataFrame([(1, 2.0, 1.0, 0.5), (2, 2.0, 1.0, 0.5)], "entity long, dx double, dy double, dz double")
    v = spark.createDataFrame([(1, 1, 1.0, None), (2, 1, None, "too fine")], "entity long, label long, volume double, volume_error string")
    got = {r.entity: r for r in validate_objects(a, e, v).collect()}
    assert got[1].error is None and got[1].rel_err == pytest.approx(0)
    assert (got[2].error, got[2].issues, got[2].rel_err) == ("volume: too fine", None, None)
