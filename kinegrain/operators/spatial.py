"""Radius, nearest-neighbour, contact and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def _cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({f"_c{a}": F.floor(F.col(a) / size).cast("long") for a in "xyz"})


def distance2(a: str, b: str) -> Column:
    """Squared distance of the columns {a}x.. and {b}x.."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "yz"), (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")))


def radius_join(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """a, b, d2 of points of left and right (idx, x, y, z) within eps: an equi-join of cells of side eps with their 27 neighbours."""
    a = _cells(left.select(F.col("idx").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *"xyz"), eps).drop(*"xyz")
    b = _cells(right.select(F.col("idx").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *"xyz"), eps).drop(*"xyz")
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    for c in "xyz":
        a = a.withColumn("_s", F.explode(step)).withColumn(f"_c{c}", F.col(f"_c{c}") + F.col("_s")).drop("_s")
    d2 = distance2("a", "b")
    return a.join(b, ["_cx", "_cy", "_cz"]).where(d2 <= eps * eps).select("a", "b", d2.alias("d2"))


def radius_pairs(points: DataFrame, eps: float) -> DataFrame:
    """a < b within eps."""
    return radius_join(points, points, eps).where("a < b")


def near_components(points: DataFrame, eps: float) -> DataFrame:
    """a, b: edges that connect points (idx, x, y, z) as all pairs within eps do, without these pairs.

    Cells are a quarter of eps wide, so a cell's points and those of the 26 cells around it are all within eps of each other: cells that touch are one
    group, and each of its points has an edge to its least one. Points of different groups meet only in cells whose boxes may be within eps.
    """
    from .graph import components

    finite = points.where(" and ".join(f"abs({c}) < double('Infinity')" for c in "xyz"))
    cell, wide = [f"_c{a}" for a in "xyz"], [f"_w{a}" for a in "xyz"]
    p = stored(finite.select("idx", *"xyz", *[F.floor(F.col(a) / (eps / 4)).cast("long").alias(n) for a, n in zip("xyz", cell)]), "near-points")
    boxes = [f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]
    each = stored(p.groupBy(*cell).agg(F.min("idx").alias("least"), *boxes), "near-cells")
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in half])).alias("_s")
    beside = each.select(F.col("least").alias("a"), *cell, step).select("a", *[(F.col(n) + F.col("_s")[k]).alias(n) for k, n in enumerate(cell)])
    groups = components(beside.join(each.select(F.col("least").alias("b"), *cell), cell).select("a", "b"))
    grouped = each.join(groups.withColumnRenamed("node", "least"), "least", "left").withColumn("g", F.coalesce("component", "least")).drop("least", "component")
    cells = stored(grouped.withColumns({w: F.floor(F.col(n) / 4).cast("long") for n, w in zip(cell, wide)}), "near-groups")
    own = p.join(cells.select("g", *cell), cell).where("idx > g").select(F.col("g").alias("a"), F.col("idx").alias("b"))

    def around(df: DataFrame) -> DataFrame:
        for w in wide:
            df = df.withColumn("_s", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn(w, F.col(w) + F.col("_s")).drop("_s")
        return df

    mixed = around(cells.select("g", *wide).distinct()).groupBy(*wide).agg(F.min("g").alias("l"), F.max("g").alias("m")).where("l < m").select(*wide)
    some = stored(cells.join(mixed, wide, "left_semi"), "near-some")
    other = some.select(*wide, *[F.col(n).alias(f"{n}2") for n in some.columns if n not in wide])
    gaps = [F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(f"hi{a}2"), F.col(f"lo{a}2") - F.col(f"hi{a}")) for a in "xyz"]
    pairs = around(some).join(other, wide).where((F.col("g") < F.col("g2")) & (sum((d * d for d in gaps[1:]), gaps[0] * gaps[0]) <= eps * eps * 1.000001))
    at = lambda n, pre: p.select(*[F.col(c).alias(c + n) for c in cell], *[F.col(a).alias(pre + a) for a in "xyz"])
    both = pairs.select("g", "g2", *cell, *[f"{c}2" for c in cell]).join(at("", "a"), cell).join(at("2", "b"), [f"{c}2" for c in cell])
    links = both.where(distance2("a", "b") <= eps * eps).select(F.col("g").alias("a"), F.col("g2").alias("b")).distinct()
    return own.union(links)


#: Points of a cell up to which a level of the grid of ``knn`` counts as fine enough, and the most levels.
CROWD, LEVELS = 256, 20


def knn(queries: DataFrame, points: DataFrame, k: int, skip_self: bool = True, crowd: int = CROWD) -> DataFrame:
    """query, idx, rank, d2: the k nearest points of each query, exact; ties by index.

    A query meets the points of its grid cell and the 26 around it. It is answered when its k-th
    neighbour is nearer than a cell's side, as no other cell has a nearer one; the rest go on with
    cells twice as wide, up to one as wide as everything. The first cells hold at most ``crowd``
    places, wherever the points are dense. Of points at one place k + 1 can count at all.
    Rows without a finite place are left out.
    """
    finite = lambda df: df.where(" and ".join(f"abs({c}) < double('Infinity')" for c in "xyz"))
    q, p = finite(queries.select("idx", *"xyz")), finite(points.select("idx", *"xyz"))
    p = stored(p.withColumn("_r", F.row_number().over(Window.partitionBy(*"xyz").orderBy("idx"))).where(F.col("_r") <= k + 1).drop("_r"), "knn-points")
    bounds = q.select(*"xyz").unionByName(p.select(*"xyz")).agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    low = bounds[0::2]
    side = 1.001 * max([hi - lo for lo, hi in zip(low, bounds[1::2]) if lo is not None], default=0.0) or 1.0
    at = lambda df, size, pre="": [F.floor((F.col(f"{pre}{c}") - F.lit(lo or 0.0)) / size).cast("long").alias(f"_c{c}") for c, lo in zip("xyz", low)]
    # all levels are counted in one pass over the places: the first one whose fullest cell is no crowd
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_l")
    places = p.select(*"xyz").distinct().select("*", level).withColumn("_s", F.lit(side) / F.pow(F.lit(2.0), F.col("_l")))
    full = places.groupBy("_l", *at(places, F.col("_s"))).count().groupBy("_l").agg(F.max("count").alias("n")).where(F.col("n") <= crowd)
    first = full.agg(F.min("_l")).first()[0]
    size = side / 2.0 ** (LEVELS if first is None else first)

    rest = q.select(F.col("idx").alias("query"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = p.select(F.col("idx"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d2, answers = distance2("a", "b"), None
    while True:
        last = size >= side
        around = rest.select("*", *at(rest, size, "a"))
        for c in "xyz":
            around = around.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn(f"_c{c}", F.col(f"_c{c}") + F.col("_s")).drop("_s")
        near = around.join(b.select("*", *at(b, size, "b")), ["_cx", "_cy", "_cz"]).select("query", "idx", d2.alias("d2"))
        if skip_self:
            near = near.where("query <> idx")
        w = Window.partitionBy("query")
        near = near.withColumn("rank", F.row_number().over(w.orderBy("d2", "idx"))).where(F.col("rank") <= k)
        near = near.withColumns({"_n": F.count(F.lit(1)).over(w), "_d": F.max("d2").over(w)})
        done = F.lit(last) | ((F.col("_n") == k) & (F.col("_d") < size * size * (1 - 1e-9)))
        found = stored(near.where(done).select("query", "idx", "rank", "d2"), "knn-found")
        answers = found if answers is None else answers.unionByName(found)
        rest = rest.join(found.select("query").distinct(), "query", "left_anti")
        if last or rest.isEmpty():
            return answers
        rest, size = stored(rest, "knn-rest"), size * 2


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """query, idx, d2: the nearest point of each query; ties by index."""
    return knn(queries, points, 1, skip_self=False).select("query", "idx", "d2")


def mutual_nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b that are each other's nearest."""
    ab = nearest(left, right).select(F.col("query").alias("a"), F.col("idx").alias("b"))
    ba = nearest(right, left).select(F.col("query").alias("b"), F.col("idx").alias("a"))
    return ab.join(ba, ["a", "b"])


def closest_frames(frames: DataFrame, targets: DataFrame, k: int, reach: int | None = None) -> DataFrame:
    """object, target, frame, rank: the nearest frame before, the nearest at or after, then the next nearest, up to k.

    Frames are numbered by object; a target meets the k before it and the k at or after it by number,
    however far they are. A ``reach`` leaves those farther away out.
    """
    order = Window.partitionBy("object").orderBy("frame")
    f = frames.select("object", "frame").withColumn("_p", F.row_number().over(order))
    both = frames.select("object", "frame", F.lit(1).alias("_f")).unionByName(targets.select("object", F.col("target").alias("frame"), F.lit(0).alias("_f")))
    # frames at the target's own place are not before it
    before = F.coalesce(F.sum("_f").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("_f").over(Window.partitionBy("object", "frame")), F.lit(0))
    t = both.withColumn("_n", before).where("_f = 0").select("object", F.col("frame").alias("target"), F.explode(F.sequence(F.col("_n") - (k - 1), F.col("_n") + k)).alias("_p"))
    near = t.join(f, ["object", "_p"])
    side = F.when(F.col("frame") < F.col("target"), 0).otherwise(1)
    gap = F.abs(F.col("frame") - F.col("target"))
    if reach is not None:
        near = near.where(gap <= reach)
    w = Window.partitionBy("object", "target")
    near = near.withColumn("_first", F.row_number().over(Window.partitionBy("object", "target", side).orderBy(gap)))
    rank = F.row_number().over(w.orderBy(F.when(F.col("_first") == 1, side).otherwise(2), gap, "frame"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("object", "target", "frame", "rank")


def memory_frames(frames: DataFrame, slots: int, stride: int = 1) -> DataFrame:
    """object, frame, slot, source: the previous frame, then strided earlier ones, where they exist."""
    want = frames.select("object", "frame", F.posexplode(F.sequence(F.lit(1), F.lit(slots))).alias("_p", "slot"))
    last = F.col("frame") - 1
    source = F.when(F.col("slot") == 1, last).otherwise(F.floor((F.col("frame") - 2) / stride) * stride - (F.col("slot") - 2) * stride)
    want = want.withColumn("source", source).drop("_p")
    have = frames.select("object", F.col("frame").alias("source"))
    return want.join(have, ["object", "source"], "left_semi").select("object", "frame", "slot", "source")


def contact_overlap(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """part, share: share of a part's points within eps of the other set."""
    near = radius_join(left, right, eps).select(F.col("a").alias("idx")).distinct().withColumn("near", F.lit(1.0))
    return left.join(near, "idx", "left").groupBy("part").agg(F.avg(F.coalesce("near", F.lit(0.0))).alias("share"))


def relax_steps(seventh: Column, start: float, step: float = 0.01, most: int = 100) -> Column:
    """How often a threshold grows before more than six distances are below it, from the seventh smallest distance."""
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor((seventh - start) / step) + 1)).cast("int")
