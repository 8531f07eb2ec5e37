"""Grids, slices, splits and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_uniform


def point_grid(spark: SparkSession, n: int) -> DataFrame:
    """n x n centres of cells in the unit square."""
    r = spark.range(n * n).withColumnRenamed("id", "cell")
    return r.select("cell", ((F.floor(F.col("cell") / n) + 0.5) / n).alias("x"), ((F.col("cell") % n + 0.5) / n).alias("y"))


def crop_boxes(spark: SparkSession, layers: int, width: int, height: int, overlap: float = 0.25) -> DataFrame:
    """layer, box of crops: 2^layer boxes on each side that overlap; layer 0 is the whole image."""
    rows = []
    for layer in range(layers + 1):
        n = 1 << layer
        lap = int(overlap * min(width, height) * (2 / n)) if layer else 0
        w, h = -(-(lap * (n - 1) + width) // n), -(-(lap * (n - 1) + height) // n)
        for i in range(n):
            for j in range(n):
                x, y = (w - lap) * i, (h - lap) * j
                rows.append((layer, x, y, min(x + w, width), min(y + h, height)))
    return spark.createDataFrame(rows, "layer int, x0 int, y0 int, x1 int, y1 int")


def slice_rows(rows: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows from place start (at least 0) to end (exclusive; all if negative) in an order; raises for an empty interval."""
    start = max(0, start)
    if 0 <= end <= start:
        raise ValueError(f"no rows from {start} to {end}")
    sorted_rows = rows.orderBy(*order).offset(start)
    return sorted_rows.limit(end - start) if end >= 0 else sorted_rows


def resample(rows: DataFrame, key: str, n: int, total: int, seed: int = 42) -> DataFrame:
    """n rows of total: a seeded permutation's prefix, topped up with seeded repetitions."""
    first = rows.withColumn("_u", hash_uniform(seed, F.col(key))).orderBy("_u", key).limit(n).drop("_u")
    if n <= total:
        return first
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(key)) - 1)
    more = rows.sparkSession.range(n - total).select(F.floor(hash_uniform(seed + 1, F.col("id")) * total).cast("int").alias("_r"))
    return first.unionByName(more.join(ranked, "_r").drop("_r"))


def nearest_crop(points: DataFrame, centre: tuple[float, float, float], k: int) -> DataFrame:
    """The k points nearest to a centre; ties by index."""
    d = sum(((F.col(a) - v) * (F.col(a) - v) for a, v in zip("xyz", centre)), F.lit(0.0))
    return points.withColumn("d2", d).orderBy("d2", "idx").limit(k)


def dropout(points: DataFrame, keys: list[str], ratio: float, seed: int = 42) -> DataFrame:
    """Points that stay when a seeded share is dropped."""
    return points.where(hash_uniform(seed, *map(F.col, keys)) >= ratio)


def surface_sample(areas: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """sample, fid, u, v, w: faces by area and barycentric places, from (fid, area)."""
    w = Window.orderBy("fid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = areas.withColumn("hi", F.sum("area").over(w)).withColumn("lo", F.col("hi") - F.col("area"))
    total = areas.agg(F.sum("area")).scalar()
    draws = areas.sparkSession.range(n).withColumnRenamed("id", "sample").withColumn("total", total)
    draws = draws.withColumn("at", hash_uniform(seed, F.col("sample"), F.lit(0)) * F.col("total"))
    # both sides are cut into slices of the total, so the range join is an equi-join
    slices = 4096
    step = F.col("total") / slices
    cdf = cdf.withColumn("total", total).withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))))
    draws = draws.withColumn("b", F.floor(F.col("at") / step))
    r1, r2 = F.sqrt(hash_uniform(seed, F.col("sample"), F.lit(1))), hash_uniform(seed, F.col("sample"), F.lit(2))
    return draws.join(cdf.drop("total"), "b").where("at >= lo and at < hi").select(
        "sample", "fid", (1 - r1).alias("u"), (r1 * (1 - r2)).alias("v"), (r1 * r2).alias("w")
    )


def area_sample_size(parts: DataFrame, entity: str, area: str, n: int = 100_000, least: int = 10_000) -> DataFrame:
    """parts with their number of sampled points: by area share, at least ``least``."""
    share = F.try_divide(F.col(area), F.sum(area).over(Window.partitionBy(entity)))
    return parts.withColumn("points", F.greatest(F.lit(least), F.floor(share * n)).cast("long"))


def batches(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """rows with their batch of ``size`` in each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size).cast("long"))
