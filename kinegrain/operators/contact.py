"""Contact between parts by exact distances of points to triangles.

Triangles are dealt into all cells of their object's grid that their boxes, widened by the reach, meet, and points into the one
cell they lie in: points and triangles nearer than the reach meet in an equi-join. A grid's cells are at least as long as the reach and
at least the object's longest extent over SLOTS, so a triangle is dealt into SLOTS cubed cells at most.

Points are rows (entity, part, idx, x, y, z), triangles rows (entity, part, px..rz), as volume.triangles() makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, stored
from .kernels import dealt
from .volume import COORDINATES, CORNERS, part_boxes

#: Cells along an object's longest extent, and shares of a cell's surfaces.
SLOTS, DEALS = 24, 16


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _difference(u: list[Column], v: list[Column]) -> list[Column]:
    return [a - b for a, b in zip(u, v)]


def squared_distance(point: list[Column], corners: list[list[Column]]) -> Column:
    """Squared distance of a point to a triangle: to its plane where the foot is inside, else to the nearest edge."""

    def edge(a: list[Column], b: list[Column]) -> Column:
        along, off = _difference(b, a), _difference(point, a)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(_dot(off, along), _dot(along, along)), F.lit(0.0))))
        rest = [o - t * d for o, d in zip(off, along)]
        return _dot(rest, rest)

    a, b, c = corners
    u, v, w = _difference(b, a), _difference(c, a), _difference(point, a)
    uu, uv, vv, wu, wv = _dot(u, u), _dot(u, v), _dot(v, v), _dot(w, u), _dot(w, v)
    den = uu * vv - uv * uv
    s, t = F.try_divide(vv * wu - uv * wv, den), F.try_divide(uu * wv - uv * wu, den)
    foot = [x - s * y - t * z for x, y, z in zip(w, u, v)]
    edges = F.least(edge(a, b), edge(b, c), edge(c, a))
    return F.when((den > 0) & (s >= 0) & (t >= 0) & (s + t <= 1), F.least(edges, _dot(foot, foot))).otherwise(edges)


def _met(points: DataFrame, ids: list[str], tri: DataFrame, reach: float, where: str = "true") -> DataFrame:
    """entity, ids, other, distance of points (entity, ids, x, y, z) to the surfaces of their object that are at most ``reach`` away.

    Triangles go to cells with points only. A cell's surfaces are dealt into DEALS shares that all its points meet, so that no task has a full cell alone,
    and a point's triangles of one surface meet in the task of the join.
    """
    extent = F.greatest(*[F.col(a + "1") - F.col(a + "0") for a in "xyz"])
    cell = F.greatest(F.lit(float(reach)), extent / SLOTS, F.lit(1e-12))
    grid = part_boxes(tri, ["entity"]).select("entity", *[a + "0" for a in "xyz"], cell.alias("cell"))
    slot = lambda v, a: F.floor((v - F.col(a + "0")) / F.col("cell"))
    keys = ["entity", *[f"i{a}" for a in "xyz"]]
    placed = stored(points.join(grid, "entity").withColumns({f"i{a}": slot(F.col(a), a) for a in "xyz"}).select(*ids, *"xyz", *keys), "placed")
    taken = stored(placed.select(*keys).distinct(), "cells")
    cells = tri.withColumnRenamed("part", "other").join(grid, "entity")
    for a in "xyz":
        own = [F.col(n + a) for n in CORNERS]
        cells = cells.withColumn(f"i{a}", F.explode(F.sequence(slot(F.least(*own) - reach, a), slot(F.greatest(*own) + reach, a))))
    cells = cells.drop("cell", *[a + "0" for a in "xyz"]).join(taken, keys, "left_semi").withColumn("_deal", F.pmod(F.hash("other"), F.lit(DEALS)))
    every = placed.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    met = dealt(every, *keys, "_deal").join(dealt(cells, *keys, "_deal"), [*keys, "_deal"]).where(where)
    d2 = squared_distance([F.col(a) for a in "xyz"], [[F.col(n + a) for a in "xyz"] for n in CORNERS])
    near = met.groupBy(*keys, "_deal", *ids, "other").agg(F.sqrt(F.greatest(F.lit(0.0), F.min(d2))).alias("distance"))
    return near.where(F.col("distance") <= reach).select("entity", *ids, "other", "distance")


def near_surfaces(points: DataFrame, tri: DataFrame, reach: float) -> DataFrame:
    """entity, part, idx, other, distance: of each point to the surface of each other part of its object that is at most ``reach`` away."""
    return _met(points, ["part", "idx"], tri, reach, "part <> other")


def _kinds(points: DataFrame, tri: DataFrame) -> DataFrame:
    """entity, part, kind, n, second: parts with the same points and the same triangles are one kind, named by its least part; it has n parts, the next least of them second.

    Points and triangles are told apart by two 64-bit hashes of each and their number.
    """

    def signature(rows: DataFrame, name: str) -> DataFrame:
        at = [x for n in rows.columns[2:] for x in (F.col(n).isNull(), F.col(n))]
        hashes = [F.bit_xor(F.xxhash64(F.lit(k), *at)).alias(f"{name}{k}") for k in (0, 1)]
        return rows.groupBy("entity", "part").agg(*hashes, F.count(F.lit(1)).alias(f"{name}2"))

    own = signature(points.groupBy("entity", "part", *"xyz").agg(F.count(F.lit(1)).alias("m")), "p")
    both = own.join(signature(tri.select("entity", "part", *COORDINATES).distinct(), "t"), ["entity", "part"], "full")
    marks = [f"{n}{k}" for n in "pt" for k in range(3)]
    each = stored(both.select("entity", "part", *[F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in marks]), "parts")
    named = each.join(each.groupBy("entity", *marks).agg(F.min("part").alias("kind"), F.count(F.lit(1)).alias("n")), ["entity", *marks]).select("entity", "part", "kind", "n")
    second = named.where("part <> kind").groupBy("entity", "kind").agg(F.min("part").alias("second"))
    return stored(named.join(second, ["entity", "kind"], "left").select("entity", "part", "kind", "n", "second"), "kinds")


def _places(points: DataFrame) -> DataFrame:
    """entity, x, y, z, place, weight: places that have points, numbered, with the number of points."""
    return stored(points.groupBy("entity", *"xyz").agg(F.count(F.lit(1)).alias("weight")).withColumn("place", F.monotonically_increasing_id()), "places")


def best_neighbours(points: DataFrame, tri: DataFrame, eps: float = 1e-3) -> DataFrame:
    """entity, part, other, touching, share: for each part the neighbour whose surface most of its points touch (nearer than eps); ties by number.

    Kinds of equal parts are compared instead of parts; a part of a kind of several is its own kind's neighbour too.
    """
    points, tri = stored(points.select("entity", "part", *"xyz"), "points"), stored(tri.select("entity", "part", *COORDINATES), "triangles")
    kinds = _kinds(points, tri)
    firsts = kinds.where("part = kind").select("entity", "part")
    members = stored(points.join(firsts, ["entity", "part"], "left_semi").groupBy("entity", F.col("part").alias("kind"), *"xyz").agg(F.count(F.lit(1)).alias("m")), "members")
    places = _places(members)
    touch = _met(places, ["place"], tri.join(firsts, ["entity", "part"], "left_semi"), eps).where(F.col("distance") < eps).select("place", "other")
    held = members.join(places, ["entity", *"xyz"]).select("place", "entity", "kind", "m")
    counts = stored(touch.join(held, "place").groupBy("entity", "kind", "other").agg(F.sum("m").alias("touching")), "touching")
    most = F.max_by(F.struct("other", "touching"), F.struct("touching", -F.col("other")))
    foreign = counts.where("kind <> other").groupBy("entity", "kind").agg(most.alias("f"))
    inner = counts.where("kind = other").select("entity", "kind", F.col("touching").alias("inner"))
    size = points.groupBy("entity", "part").agg(F.count(F.lit(1)).alias("size"))
    each = kinds.join(foreign, ["entity", "kind"], "left").join(inner, ["entity", "kind"], "left").join(size, ["entity", "part"])
    twin = F.when((F.col("n") > 1) & F.col("inner").isNotNull(), F.struct(F.when(F.col("part") == F.col("kind"), F.col("second")).otherwise(F.col("kind")).alias("other"), F.col("inner").alias("touching")))
    more = (twin["touching"] > F.col("f.touching")) | ((twin["touching"] == F.col("f.touching")) & (twin["other"] < F.col("f.other")))
    best = each.select("entity", "part", "size", F.when(F.col("f").isNull() | more, twin).otherwise(F.col("f")).alias("b")).where("b is not null")
    return best.select("entity", "part", "b.other", "b.touching", (F.col("b.touching") / F.col("size")).alias("share"))


def contact_regions(points: DataFrame, tri: DataFrame, threshold: float = 0.01, step: float = 0.01, least: int = 7, most_steps: int = 1000) -> DataFrame:
    """entity, part, relaxations, size: how often a part's threshold grows by ``step`` until at least ``least`` of the *other* parts' points (all, if
    there are fewer) are nearer to its surface, and how many are then; it grows ``most_steps`` times at most.

    All thresholds are answered by one order of distances: the number of steps follows from the least-th. The reach grows eightfold for the parts
    that have too few points in it, until it spans their object. Equal parts have equal answers, and points at one place equal distances, so
    kinds of parts meet places, which count as often as the other parts have points there.
    """
    points, tri = stored(points.select("entity", "part", *"xyz"), "points"), stored(tri.select("entity", "part", *COORDINATES), "triangles")
    kinds = _kinds(points, tri)
    firsts = kinds.where("part = kind").select("entity", "part")
    others = points.groupBy("entity").agg(F.count(F.lit(1)).alias("all")).join(points.groupBy("entity", "part").agg(F.count(F.lit(1)).alias("own")), "entity")
    others = others.join(firsts, ["entity", "part"], "left_semi")
    want = stored(others.select("entity", "part", F.least(F.lit(least), F.col("all") - F.col("own")).alias("want")).where("want > 0"), "want")
    places = _places(points)
    own = points.join(firsts, ["entity", "part"], "left_semi").groupBy("entity", "part", *"xyz").agg(F.count(F.lit(1)).alias("m"))
    own = stored(own.join(places, ["entity", *"xyz"]).select("place", "part", "m"), "own")
    spans = [F.max(a) - F.min(a) for a in "xyz"]
    extent = F.greatest(*[F.col(a + "1") - F.col(a + "0") for a in "xyz"])
    top = sum(x or 0.0 for x in (part_boxes(tri, ["entity"]).agg(F.max(extent)).first()[0], *points.agg(*spans).first()))
    reach, todo, done = threshold + 20 * step, want, None
    while not todo.isEmpty():
        surfaces = tri.join(todo.select("entity", "part"), ["entity", "part"], "left_semi")
        met = _met(places, ["place", "weight"], surfaces, reach).withColumnRenamed("other", "part").join(own, ["place", "part"], "left")
        count = F.col("weight") - F.coalesce("m", F.lit(0))
        near = stored(met.where(count > 0).groupBy("entity", "part", "distance").agg(F.sum(count).alias("count")), "near")
        upto = near.withColumn("upto", F.sum("count").over(Window.partitionBy("entity", "part").orderBy("distance")))
        kth = upto.join(todo, ["entity", "part"]).where("upto >= want").groupBy("entity", "part").agg(F.min("distance").alias("kth"))
        steps = F.least(F.lit(most_steps), F.when(F.col("kth") < threshold, 0).otherwise(F.floor(F.round((F.col("kth") - threshold) / step, 9)) + 1)).cast("int")
        found = kth.withColumn("relaxations", steps)
        # the last threshold has to be in reach, so that the points nearer than it are counted whole
        found = stored(found.where(threshold + F.col("relaxations") * step <= reach if reach < 2 * top else F.lit(True)), "found")
        size = near.join(found, ["entity", "part"]).where(F.col("distance") < threshold + F.col("relaxations") * step).groupBy("entity", "part").agg(F.sum("count").alias("size"))
        got = stored(found.select("entity", "part", "relaxations").join(size, ["entity", "part"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long"))), "found")
        done = got if done is None else done.unionByName(got)
        left = stored(todo.join(got.select("entity", "part"), ["entity", "part"], "left_anti"), "want")
        discard(todo, near, found)
        todo = left
        if reach >= 2 * top:
            break
        reach = 8 * reach
    each = kinds.join(points.select("entity", "part").distinct(), ["entity", "part"], "left_semi")
    if done is None:
        return each.select("entity", "part", F.lit(0).alias("relaxations"), F.lit(0).cast("long").alias("size")).limit(0)
    return each.select("entity", "part", "kind").join(done.withColumnRenamed("part", "kind"), ["entity", "kind"]).select("entity", "part", "relaxations", "size")


def error_points(pixels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """image, draw, row, col, label of pixels (image, row, col, gold, mask: booleans): n clicks for each image, drawn from where the mask is wrong.

    A click is positive (1) where the mask lacks the object, negative (0) where it goes beyond; without an error it is a negative one on the
    background. Each draw takes the pixel with the greatest number of its own, by a hash of seed, image, draw and place, so draws are independent, and
    a partial maximum leaves each task.
    """
    from ..functions.numeric import hash_uniform

    lacking, beyond = F.col("gold") & ~F.col("mask"), ~F.col("gold") & F.col("mask")
    kind = F.when(lacking | beyond, 1).when(~F.col("gold"), 0)
    rows = pixels.withColumn("_kind", kind).where("_kind is not null").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    chance = hash_uniform(seed, F.col("image"), F.col("draw"), F.col("row"), F.col("col"))
    pick = rows.groupBy("image", "draw").agg(F.max_by(F.struct("row", "col", lacking.cast("int").alias("label")), F.struct("_kind", chance, "row", "col")).alias("p"))
    return pick.select("image", "draw", "p.row", "p.col", "p.label")
