"""Volumes of part meshes: signed, convex hull, voxel (surface, solid and filled), and by samples.

Triangles come as rows of the part's keys and nine coordinates (px..rz), so the work is dealt
by triangle, cell column and sample, never by part: a part with a third of all triangles is
summed in many tasks. Only hulls are computed in Python, on chunks of a part's points, and
once more on the corners of the chunks' hulls.

A grid's cells are centred on multiples of ``pitch``, the part's longest extent over
``resolution``. A surface cell holds a point of the triangles' lattices, which halve edges until they
are half a cell long; a solid cell's centre is inside by parity: each column of centres is cut by the
triangles it passes, and every other stretch between the cuts is inside. A filled cell is either.
A column with an odd number of cuts shows an open mesh; its last cut is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_uniform
from .kernels import dealt as spread
from .mesh import corners

AXES = "xyz"
CORNERS = "pqr"
COORDINATES = [n + a for n in CORNERS for a in AXES]

#: Cells along the longest extent, and lattice points of a part beyond which it is too fine to be measured.
RESOLUTION, MOST_POINTS = 128, 1 << 28
#: Points of a chunk that one hull is made of.
CHUNK = 4096


def triangles(faces: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, px..rz of faces (keys, fid, v0, v1, v2) and points (idx, x, y, z); faces without all corners are left out."""
    t = corners(faces.select(*keys, "fid", "v0", "v1", "v2"), points)
    return t.select(*keys, *[F.element_at("c", F.lit(k))[d].alias(n + a) for k, n in enumerate(CORNERS) for d, a in enumerate(AXES)])


def _vector(name: str, origin: str | None = None) -> list[Column]:
    return [F.col(name + a) - F.col(origin + a) if origin else F.col(name + a) for a in AXES]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def mesh_volumes(tri: DataFrame, keys: list[str]) -> DataFrame:
    """keys, volume: what closed, outward faces enclose, by the divergence theorem; negative if they face inward."""
    p, n = _vector("p"), _cross(_vector("q"), _vector("r"))
    return tri.groupBy(*keys).agg((F.sum(p[0] * n[0] + p[1] * n[1] + p[2] * n[2]) / 6).alias("volume"))


def part_boxes(tri: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x0..z0, x1..z1: axis-aligned boxes of parts."""
    low = [F.min(F.least(*[F.col(n + a) for n in CORNERS])).alias(a + "0") for a in AXES]
    high = [F.max(F.greatest(*[F.col(n + a) for n in CORNERS])).alias(a + "1") for a in AXES]
    return tri.groupBy(*keys).agg(*low, *high)


def box_volumes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    sides = [F.col(a + "1") - F.col(a + "0") for a in AXES]
    return boxes.select(*keys, (sides[0] * sides[1] * sides[2]).alias("volume"))


def _halvings(pitch: Column) -> Column:
    """Parts of each edge in a triangle's lattice: a power of two that makes all edges at most half a pitch long."""
    edges = [_vector(b, a) for a, b in ("pq", "qr", "rp")]
    longest = F.sqrt(F.greatest(*[u[0] * u[0] + u[1] * u[1] + u[2] * u[2] for u in edges]))
    return F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(longest / (pitch / 2), F.lit(1e-9)))).cast("double"))).cast("long")


def _crossed(x: Column, y: Column) -> Column:
    """Whether (x, y) is in the shadow of the triangle on the xy plane: an odd number of its edges to the right. Edges that
    triangles share are cut alike whichever way they run, so each point is in one of two neighbours only."""

    def right(a: str, b: str) -> Column:
        ay, by = F.col(a + "y"), F.col(b + "y")
        up = ay <= by
        lx, ly = F.when(up, F.col(a + "x")).otherwise(F.col(b + "x")), F.least(ay, by)
        hx, hy = F.when(up, F.col(b + "x")).otherwise(F.col(a + "x")), F.greatest(ay, by)
        return F.when((ay > y) != (by > y), x < lx + (y - ly) * (hx - lx) / (hy - ly)).otherwise(False).cast("int")

    return (right("p", "q") + right("q", "r") + right("r", "p")) % 2 == 1


def _height(x: Column, y: Column) -> Column:
    """z of the triangle's plane above (x, y), inside the triangle's own range."""
    n = _cross(_vector("q", "p"), _vector("r", "p"))
    z = F.col("pz") - (n[0] * (x - F.col("px")) + n[1] * (y - F.col("py"))) / F.nullif(n[2], F.lit(0.0))
    tops = [F.col(c + "z") for c in CORNERS]
    return F.least(F.greatest(z, F.least(*tops)), F.greatest(*tops))


def voxel_volumes(tri: DataFrame, keys: list[str], resolution: int = RESOLUTION, most_points: int = MOST_POINTS) -> DataFrame:
    """keys, pitch, surface_cells, solid_cells, filled_cells, open_columns, volume (of filled cells), error: one row for each part.

    A part whose extents are all 0 is ``flat``, and one whose lattices have more than ``most_points`` points is ``too fine``; both have no counts.
    """
    extent = F.greatest(*[F.col(a + "1") - F.col(a + "0") for a in AXES])
    # to 13 digits: differences of corners are noise beyond, and points midway between two cells would follow it
    extent = F.when(extent >= 0, F.format_string("%.12e", extent).cast("double"))
    boxes = part_boxes(tri, keys).select(*keys, (extent / resolution).alias("pitch"))
    sized = tri.join(boxes, keys).withColumn("n", F.when(F.col("pitch") > 0, _halvings(F.col("pitch"))))
    n = F.col("n").cast("double")
    parts = sized.groupBy(*keys).agg(F.first("pitch").alias("pitch"), F.sum((n + 1) * (n + 2) / 2).alias("points"))
    error = F.when(F.col("points").isNull(), "flat").when(F.col("points") > most_points, "too fine")
    parts = parts.select(*keys, "pitch", error.alias("error"))
    good = sized.join(parts.where("error is null").select(*keys), keys, "left_semi")

    on_lattice = good.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("i"))).alias("j"))
    at = [F.col("p" + a) + (F.col("q" + a) - F.col("p" + a)) * F.col("i") / F.col("n") + (F.col("r" + a) - F.col("p" + a)) * F.col("j") / F.col("n") for a in AXES]
    cells = [F.rint(c / F.col("pitch")).cast("long") for c in at]
    surface = on_lattice.select(*keys, *[c.alias(f"c{a}") for c, a in zip(cells, AXES)], F.lit(None).cast("double").alias("cut"))

    def centres(a: str) -> Column:
        """Indices of cell centres between the triangle's least and greatest coordinate."""
        own = [F.col(c + a) for c in CORNERS]
        lo, hi = F.ceil(F.least(*own) / F.col("pitch")), F.floor(F.greatest(*own) / F.col("pitch"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    columns = good.select("*", F.explode(centres("x")).alias("cx")).select("*", F.explode(centres("y")).alias("cy"))
    x, y = F.col("cx") * F.col("pitch"), F.col("cy") * F.col("pitch")
    cuts = columns.where(_crossed(x, y)).select(*keys, "cx", "cy", F.lit(None).cast("long").alias("cz"), (_height(x, y) / F.col("pitch")).alias("cut")).where("cut is not null")

    both = surface.unionByName(cuts).groupBy(*keys, "cx", "cy").agg(F.collect_set("cz").alias("cells"), F.array_sort(F.collect_list("cut")).alias("cuts"))
    pairs = F.filter(F.sequence(F.lit(0), F.size("cuts")), lambda i: (i % 2 == 0) & (i + 1 < F.size("cuts")))
    runs = F.transform(pairs, lambda i: F.struct((F.floor(F.get("cuts", i)) + 1).alias("lo"), F.floor(F.get("cuts", i + 1)).alias("hi")))
    both = both.select(*keys, "cells", runs.alias("runs"), (F.size("cuts") % 2).alias("open"))
    solid = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + F.greatest(F.lit(0).cast("long"), r["hi"] - r["lo"] + 1))
    alone = F.size(F.filter("cells", lambda k: ~F.exists("runs", lambda r: (r["lo"] <= k) & (k <= r["hi"]))))
    counts = both.groupBy(*keys).agg(
        F.sum(F.size("cells")).cast("long").alias("surface_cells"), F.sum(solid).cast("long").alias("solid_cells"),
        F.sum(solid + alone).cast("long").alias("filled_cells"), F.sum("open").cast("long").alias("open_columns"),
    )
    out = parts.join(counts, keys, "left")
    return out.select(*keys, "pitch", *counts.columns[len(keys) :], (F.col("filled_cells") * F.pow("pitch", F.lit(3.0))).alias("volume"), "error")


def sampled_volumes(tri: DataFrame, keys: list[str], samples: int = 2000, seed: int = 42, slots: int = 16) -> DataFrame:
    """keys, inside (samples), volume: the share of a part's seeded samples that are inside, times its box.

    Samples and triangles meet in slots x slots columns of the box, and a sample is inside if an odd number of triangles is above it.
    """
    boxes = part_boxes(tri, keys)
    slot = lambda v, a: F.least(F.lit(slots - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((v - F.col(a + "0")) / (F.col(a + "1") - F.col(a + "0")) * slots)))
    drawn = boxes.where("x1 > x0 and y1 > y0").select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    at = {a: F.col(a + "0") + hash_uniform(seed, *map(F.col, keys), F.lit(a), F.col("sample")) * (F.col(a + "1") - F.col(a + "0")) for a in AXES}
    drawn = drawn.withColumns({"s" + a: v for a, v in at.items()})
    drawn = drawn.select(*keys, "sample", "sx", "sy", "sz", slot(F.col("sx"), "x").alias("ix"), slot(F.col("sy"), "y").alias("iy"))
    dealt = tri.join(boxes, keys)
    for a in "xy":
        own = [F.col(c + a) for c in CORNERS]
        dealt = dealt.where(F.col(a + "1") > F.col(a + "0")).withColumn("i" + a, F.explode(F.sequence(slot(F.least(*own), a), slot(F.greatest(*own), a))))
    met = drawn.join(dealt.select(*keys, "ix", "iy", *COORDINATES), [*keys, "ix", "iy"])
    above = met.where(_crossed(F.col("sx"), F.col("sy"))).where(_height(F.col("sx"), F.col("sy")) > F.col("sz"))
    inside = above.groupBy(*keys, "sample").count().where(F.col("count") % 2 == 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"))
    whole = box_volumes(boxes, keys).join(inside, keys, "left").withColumn("inside", F.coalesce("inside", F.lit(0)).cast("long"))
    return whole.select(*keys, "inside", (F.col("volume") * F.col("inside") / samples).alias("volume"))


def _plane_hull(flat: np.ndarray) -> list[int]:
    """Corners of points in the plane, by their lower and upper chain."""
    flat = flat / max(np.abs(flat).max(initial=0.0), 1e-300)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    out: list[int] = []
    for run in (order, order[::-1]):
        chain: list[int] = []
        for i in run.tolist():
            while len(chain) > 1:
                (ax, ay), (bx, by), (cx, cy) = flat[chain[-2]], flat[chain[-1]], flat[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 1e-12:
                    break
                chain.pop()
            chain.append(i)
        out += chain[:-1]
    return sorted(set(out)) or order[:1].tolist()


def convex_hull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners (indices), outward faces (rows of three indices; none if the points lie in a plane)) of points (n x 3).

    Faces are grown from a tetrahedron of far points: the point farthest from a face that sees it replaces all faces it sees.
    """
    points = np.asarray(points, float)
    none = np.zeros((0, 3), int)
    centre = points.mean(axis=0)
    scale = np.abs(points - centre).max(initial=0.0)
    near = 1e-9 * scale
    first = int(np.argmax(((points - centre) ** 2).sum(axis=1)))
    second = int(np.argmax(((points - points[first]) ** 2).sum(axis=1)))
    line = points[second] - points[first]
    if np.linalg.norm(line) <= near:
        return np.array([first]), none
    line = line / np.linalg.norm(line)
    off = points - points[first]
    off = off - np.outer(off @ line, line)
    third = int(np.argmax((off**2).sum(axis=1)))
    if np.linalg.norm(off[third]) <= near:
        return np.array(sorted({first, second})), none
    across = off[third] / np.linalg.norm(off[third])
    normal = np.cross(line, across)
    high = (points - points[first]) @ normal
    fourth = int(np.argmax(np.abs(high)))
    if abs(high[fourth]) <= near:
        flat = np.stack([(points - points[first]) @ line, (points - points[first]) @ across], axis=1)
        return np.array(_plane_hull(flat)), none
    inner = points[[first, second, third, fourth]].mean(axis=0)
    faces: dict[int, tuple[tuple[int, int, int], np.ndarray, float, np.ndarray]] = {}
    edges: dict[tuple[int, int], int] = {}

    def add(a: int, b: int, c: int, rest: np.ndarray, turn: bool = False) -> None:
        n = np.cross(points[b] - points[a], points[c] - points[a])
        length = np.linalg.norm(n)
        n = n / length if length else n
        if turn and n @ (inner - points[a]) > 0:
            b, c, n = c, b, -n
        d = float(n @ points[a])
        seen = rest[points[rest] @ n - d > near] if len(rest) else rest
        number = next(numbers)
        faces[number] = ((a, b, c), n, d, seen)
        edges.update({(a, b): number, (b, c): number, (c, a): number})
        if len(seen):
            todo.append(number)

    numbers, todo = iter(range(1 << 62)), []
    rest = np.setdiff1d(np.arange(len(points)), [first, second, third, fourth])
    for a, b, c in ((first, second, third), (first, second, fourth), (first, third, fourth), (second, third, fourth)):
        add(a, b, c, rest, True)
    while todo:
        number = todo.pop()
        if number not in faces:
            continue
        (_, n, d, seen) = faces[number]
        top = int(seen[np.argmax(points[seen] @ n)])
        # the faces that see the point are connected
        visible, walk = {number}, [number]
        while walk:
            a, b, c = faces[walk.pop()][0]
            for edge in ((b, a), (c, b), (a, c)):
                other = edges[edge]
                if other not in visible and points[top] @ faces[other][1] - faces[other][2] > near:
                    visible.add(other)
                    walk.append(other)
        rim = [(x, y) for f in visible for x, y in ((faces[f][0][0], faces[f][0][1]), (faces[f][0][1], faces[f][0][2]), (faces[f][0][2], faces[f][0][0])) if edges[y, x] not in visible]
        open_points = np.unique(np.concatenate([faces[f][3] for f in visible]))
        open_points = open_points[open_points != top]
        for f in visible:
            del faces[f]
        for x, y in rim:
            add(x, y, top, open_points)
    table = np.array([f[0] for f in faces.values()])
    return np.unique(table), table


def hull_volume(points: np.ndarray) -> float:
    _, faces = convex_hull(points)
    if not len(faces):
        return 0.0
    a, b, c = (points[faces[:, k]] - points.mean(axis=0) for k in range(3))
    return float(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6)


def hull_volumes(points: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """keys, volume of the convex hull of each part's points (keys, x, y, z); 0 for points in a plane.

    A part's points are dealt into chunks by their hash; corners of the chunks' hulls are all that meet in the part's last hull.
    """
    xyz = points.select(*keys, *[F.col(a).cast("double").alias(a) for a in AXES]).where("x is not null and y is not null and z is not null").distinct()
    sizes = xyz.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    dealt = xyz.join(sizes, keys).withColumn("_chunk", F.pmod(F.xxhash64(*AXES), F.ceil(F.col("_n") / chunk).cast("long"))).drop("_n")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in xyz.schema.fields if f.name in keys)

    def corners_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[convex_hull(pdf[list(AXES)].to_numpy())[0]][[*keys, *AXES]]

    def volume_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*pdf[keys].iloc[0], hull_volume(pdf[list(AXES)].to_numpy())]], columns=[*keys, "volume"])

    few = spread(dealt, *keys, "_chunk").groupBy(*keys, "_chunk").applyInPandas(corners_of, f"{kinds}, x double, y double, z double")
    return spread(few, *keys).groupBy(*keys).applyInPandas(volume_of, f"{kinds}, volume double")
