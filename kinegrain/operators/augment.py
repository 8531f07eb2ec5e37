"""Seeded augmentations of point clouds: every random number is a hash of the seed and the row's keys, so retries and reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import gray
from ..functions.numeric import hash_uniform
from ..plans.registry import TRANSFORMS


def _normal(seed: int, *keys):
    """A standard normal number from two uniforms."""
    u, v = F.greatest(hash_uniform(seed, *keys), F.lit(1e-12)), hash_uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


@TRANSFORMS.register()
def jitter(points: DataFrame, sigma: float = 0.01, clip: float = 0.05, share: float = 1.0, seed: int = 1) -> DataFrame:
    """Clipped normal noise on a share of the points."""
    hit = hash_uniform(seed, F.col("idx")) < share
    noise = {a: F.greatest(F.lit(-clip), F.least(F.lit(clip), sigma * _normal(seed + 10 * (k + 1), F.col("idx")))) for k, a in enumerate("xyz")}
    return points.withColumns({a: F.col(a) + F.when(hit, n).otherwise(0.0) for a, n in noise.items()})


@TRANSFORMS.register()
def rotate(points: DataFrame, key: str = "part", most: float = math.pi, seed: int = 2) -> DataFrame:
    """One angle about z for each cloud."""
    a = (hash_uniform(seed, F.col(key)) * 2 - 1) * most
    return points.withColumns({"x": F.col("x") * F.cos(a) - F.col("y") * F.sin(a), "y": F.col("x") * F.sin(a) + F.col("y") * F.cos(a)})


@TRANSFORMS.register()
def scale(points: DataFrame, key: str = "part", low: float = 0.75, high: float = 1.25, seed: int = 3) -> DataFrame:
    s = low + (high - low) * hash_uniform(seed, F.col(key))
    return points.withColumns({a: F.col(a) * s for a in "xyz"})


@TRANSFORMS.register()
def flip(points: DataFrame, key: str = "part", p: float = 0.5, seed: int = 4) -> DataFrame:
    s = F.when(hash_uniform(seed, F.col(key)) < p, -1.0).otherwise(1.0)
    return points.withColumn("x", F.col("x") * s)


@TRANSFORMS.register()
def shift(points: DataFrame, key: str = "part", most: float = 0.2, seed: int = 5) -> DataFrame:
    return points.withColumns({a: F.col(a) + (hash_uniform(seed + k, F.col(key)) * 2 - 1) * most for k, a in enumerate("xyz")})


@TRANSFORMS.register()
def grayscale(points: DataFrame, key: str = "part", p: float = 0.2, seed: int = 6) -> DataFrame:
    g = F.floor(gray(F.col("r"), F.col("g"), F.col("b"))).cast("long")
    hit = hash_uniform(seed, F.col(key)) < p
    return points.select(*[F.when(hit, g).otherwise(F.col(n)).alias(n) if n in ("r", "g", "b") else F.col(n) for n in points.columns])


@TRANSFORMS.register()
def auto_contrast(points: DataFrame, key: str = "part", blend: float = 0.5) -> DataFrame:
    """Channels stretched to 0..255 over their cloud, blended with the original."""
    ends = points.groupBy(key).agg(*[f(c).alias(f"_{n}{c}") for c in "rgb" for n, f in (("lo", F.min), ("hi", F.max))])
    j = points.join(ends, key)
    full = lambda c: F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo{c}")) * 255.0, F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.col(c).cast("double"))
    return j.withColumns({c: F.floor((1 - blend) * F.col(c) + blend * full(c)).cast("long") for c in "rgb"}).select(*points.columns)


@TRANSFORMS.register()
def drop_colour(points: DataFrame, key: str = "part", p: float = 0.2, seed: int = 7) -> DataFrame:
    keep = F.when(hash_uniform(seed, F.col(key)) < p, 0).otherwise(1)
    return points.withColumns({c: F.col(c) * keep for c in "rgb"})


@TRANSFORMS.register()
def dropout(points: DataFrame, ratio: float = 0.2, seed: int = 8) -> DataFrame:
    return points.where(hash_uniform(seed, F.col("idx")) >= ratio)


@TRANSFORMS.register()
def mask_text(rows: DataFrame, column: str, p: float = 0.3, seed: int = 9, key: str = "idx") -> DataFrame:
    return rows.withColumn(column, F.when(hash_uniform(seed, F.col(key)) >= p, F.col(column)))


def views(points: DataFrame, n: int, configs: list[dict]) -> DataFrame:
    """Points in n copies with view, each augmented by its own seeds."""
    many = points.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return TRANSFORMS.compose(configs)(many)


def instances(points: DataFrame, label: str, ignore: list[int]) -> DataFrame:
    """instance (dense from 0), centre and box of the labels that count."""
    from pyspark.sql import Window

    kept = points.where(~F.col(label).isin(ignore))
    g = kept.groupBy(label).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"], *[(F.max(a) - F.min(a)).alias(f"s{a}") for a in "xyz"], F.count(F.lit(1)).alias("n"))
    return g.withColumn("instance", F.row_number().over(Window.orderBy(label)) - 1)


def sampled_transform(seed: int, *keys: Column, any_axis: bool = True, scale: tuple[float, float] = (0.75, 1.25)) -> Column:
    """(axis, angle, scaling, matrix): one seeded rotation about an axis, and a scaling, for all rows of the same keys."""
    draw = lambda what: hash_uniform(seed, *keys, F.lit(what))
    angle = draw("angle") * (2 * math.pi)
    axis = F.get(F.array(*map(F.lit, "xyz")), F.floor(draw("axis") * 3).cast("int")) if any_axis else F.lit("z")
    co, si, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    about = {"x": (one, zero, zero, zero, co, -si, zero, si, co), "y": (co, zero, si, zero, one, zero, -si, zero, co), "z": (co, -si, zero, si, co, zero, zero, zero, one)}
    matrix = F.when(axis == "x", F.array(*about["x"])).when(axis == "y", F.array(*about["y"])).otherwise(F.array(*about["z"]))
    return F.struct(axis.alias("axis"), angle.alias("angle"), (scale[0] + draw("scale") * (scale[1] - scale[0])).alias("scaling"), matrix.alias("matrix"))
