"""Masks, rasters, runs and voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority_vote(pixels: DataFrame, face: str, mask: str, order: str) -> DataFrame:
    """face, mask, votes: the mask with most pixels of a face, of equal ones the first seen."""
    votes = pixels.groupBy(face, mask).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    best = votes.groupBy(face).agg(F.min_by(F.struct(mask, "votes"), F.struct(-F.col("votes"), "_first")).alias("b"))
    return best.select(face, f"b.{mask}", "b.votes")


def rle_encode(bits: DataFrame, mask: str, pos: str, bit: str) -> DataFrame:
    """mask, run, bit, length: runs of equal bits in order of pos."""
    w = Window.partitionBy(mask).orderBy(pos)
    change = F.when(F.lag(bit).over(w) == F.col(bit), 0).otherwise(1)
    runs = bits.withColumn("_c", change).withColumn("run", F.sum("_c").over(w) - 1)
    return runs.groupBy(mask, "run", bit).agg(F.count(F.lit(1)).alias("length"))


def rle_counts(runs: DataFrame, mask: str, bit: str) -> DataFrame:
    """mask, counts: run lengths that start with a run of zeros, of length 0 if the first bit is one."""
    ordered = F.array_sort(F.collect_list(F.struct("run", F.col(bit).alias("bit"), "length")))
    g = runs.groupBy(mask).agg(ordered.alias("r"))
    counts = F.transform("r", lambda x: x["length"])
    return g.select(mask, F.when(F.col("r")[0]["bit"] == 1, F.concat(F.array(F.lit(0).cast("long")), counts)).otherwise(counts).alias("counts"))


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def rle_decode(masks: DataFrame, mask: str, counts: str = "counts") -> DataFrame:
    """mask, pos, bit from run lengths."""
    w = Window.partitionBy(mask).orderBy("run")
    runs = masks.select(mask, F.posexplode(counts).alias("run", "length"))
    runs = runs.withColumn("start", F.sum("length").over(w) - F.col("length")).where("length > 0")
    return runs.select(mask, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"), (F.col("run") % 2).cast("int").alias("bit"))


def mask_box(pixels: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """keys and the box of their pixels."""
    return pixels.groupBy(*keys).agg(F.min(row).alias("r0"), F.max(row).alias("r1"), F.min(col).alias("c0"), F.max(col).alias("c1"), F.count(F.lit(1)).alias("area"))


def stability(logit: Column, threshold: float, offset: float) -> Column:
    """Aggregate: pixels surely inside over pixels perhaps inside."""
    return F.try_divide(F.count_if(logit > threshold + offset), F.count_if(logit > threshold - offset))


def overpaint(pixels: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last painter's value of each pixel."""
    return pixels.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def pair_overlaps(rows: DataFrame, mask: str, face: str, area: str) -> DataFrame:
    """a, b, inter, iou, containment of masks that share a face, by area; an equi-join on the face, not all pairs."""
    one = rows.groupBy(mask, face).agg(F.first(area).alias(area))
    size = one.groupBy(mask).agg(F.sum(area).alias("size"))
    x = one.select(F.col(mask).alias("a"), face, area)
    y = one.select(F.col(mask).alias("b"), face)
    inter = x.join(y, face).where("a < b").groupBy("a", "b").agg(F.sum(area).alias("inter"))
    sa, sb = size.select(F.col(mask).alias("a"), F.col("size").alias("sa")), size.select(F.col(mask).alias("b"), F.col("size").alias("sb"))
    j = inter.join(sa, "a").join(sb, "b")
    return j.select("a", "b", "inter", F.try_divide("inter", F.col("sa") + F.col("sb") - F.col("inter")).alias("iou"), F.try_divide("inter", F.least("sa", "sb")).alias("containment"))


def coverage_prefix(masks: DataFrame, keys: list[str], area: str, tie: str, share: float = 0.99) -> DataFrame:
    """Masks by area until ``share`` of their group's area is covered; the check precedes the addition."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc(area), tie)
    before = F.coalesce(F.sum(area).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return masks.withColumns({"_before": before, "_all": F.sum(area).over(w)}).where(F.col("_before") <= share * F.col("_all")).drop("_before", "_all")


def combine_batches(pixels: DataFrame, keys: list[str], face: str, batch: str, size: int) -> DataFrame:
    """Face ids of render batches as one raster: positive ids are moved by batch * size, and the greatest counts."""
    own = F.when(F.col(face) > 0, F.col(face) + F.col(batch) * size).otherwise(F.lit(0))
    return pixels.groupBy(*keys).agg(F.max(own).alias(face))


def voxelise(points: DataFrame, size: float, coords: tuple[str, str, str] = ("x", "y", "z"), bins: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """points with gx, gy, gz: cells from their group's least corner, clipped to ``bins``."""
    w = Window.partitionBy(*keys)
    out = points
    for c in coords:
        cell = F.floor(F.col(c) / size).cast("long")
        out = out.withColumn(f"_{c}", cell)
    if keys:
        grid = {f"g{c}": F.col(f"_{c}") - F.min(f"_{c}").over(w) for c in coords}
        out = out.withColumns(grid)
    else:
        low = out.agg(*[F.min(f"_{c}").alias(f"_m{c}") for c in coords])
        out = out.crossJoin(F.broadcast(low)).withColumns({f"g{c}": F.col(f"_{c}") - F.col(f"_m{c}") for c in coords}).drop(*[f"_m{c}" for c in coords])
    if bins:
        out = out.withColumns({f"g{c}": F.least(F.greatest(F.col(f"g{c}"), F.lit(0)), F.lit(bins)).cast("long") for c in coords})
    return out.drop(*[f"_{c}" for c in coords])


CELL = ["gx", "gy", "gz"]


def voxel_representative(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One point of each cell: that at (greatest count // 2) % count of the cell's points by order."""
    w = Window.partitionBy(*keys, *CELL)
    counted = points.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(order)) - 1})
    top = counted.groupBy(*keys).agg(F.max("_n").alias("_top")) if keys else counted.agg(F.max("_n").alias("_top"))
    joined = counted.join(top, keys) if keys else counted.crossJoin(F.broadcast(top))
    return joined.where(F.col("_r") == F.floor(F.col("_top") / 2) % F.col("_n")).drop("_n", "_r", "_top")


def voxel_fragments(points: DataFrame, order: str) -> DataFrame:
    """fragment, cell and point for i = 0 .. greatest count - 1: the point at i % count of each cell."""
    w = Window.partitionBy(*CELL)
    counted = points.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(order)) - 1})
    top = counted.agg(F.max("_n").alias("_top"))
    out = counted.crossJoin(F.broadcast(top)).withColumn("fragment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top") - 1)))
    return out.where(F.col("fragment") % F.col("_n") == F.col("_r")).drop("_n", "_r", "_top")


def grid_pool(points: DataFrame, keys: list[str], stride: int, features: list[str], how: str = "max") -> DataFrame:
    """Cells of ``stride`` cells: features by max, sum, mean or min, coordinates by mean."""
    f = {"max": F.max, "sum": F.sum, "mean": F.avg, "min": F.min}[how]
    cells = [F.floor(F.col(c) / stride).cast("long").alias(c) for c in CELL]
    return points.groupBy(*keys, *cells).agg(*[f(x).alias(x) for x in features], *[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))


def grid_unpool(points: DataFrame, pooled: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """points with their parent cell's columns."""
    parent = [F.floor(F.col(c) / stride).cast("long").alias(f"p{c}") for c in CELL]
    named = pooled.select(*keys, *[F.col(c).alias(f"p{c}") for c in CELL], *[F.col(c).alias(f"pooled_{c}") for c in pooled.columns if c not in (*keys, *CELL)])
    return points.select("*", *parent).join(named, [*keys, *[f"p{c}" for c in CELL]])


def bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Box, centre and greatest half extent of groups of points."""
    ends = [e for c in "xyz" for e in (F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"))]
    b = points.groupBy(*keys).agg(*ends)
    return b.select("*", *[((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(f"c{c}") for c in "xyz"], F.greatest(*[(F.col(f"{c}1") - F.col(f"{c}0")) / 2 for c in "xyz"]).alias("half"))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    return F.try_divide(w * h, area(a) + area(b) - w * h)
