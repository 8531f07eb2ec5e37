"""Numeric rules as Column expressions; null stands for every missing or unusable value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonv import once

#: What counts as a number in a JSON string.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def lit(x) -> Column:
    return F.lit(float(x))


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def as_float(v: Column) -> Column:
    """A variant's number, or the number in its string; null for booleans, other kinds and non-finite values."""
    text = F.trim(F.try_variant_get(v, "$", "string"))
    number = lambda k, t: k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") | ((k == "STRING") & t.rlike(NUMBER))
    value = once(F.struct(F.schema_of_variant(v).alias("k"), text.alias("t")), lambda x: F.when(number(x["k"], x["t"]), x["t"].try_cast("double")))
    return once(value, finite)


def numeric_vector(v: Column, n: int) -> Column:
    """An array of exactly n usable numbers, else null."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), as_float)
    return once(items, lambda a: F.when((F.size(a) == n) & F.forall(a, lambda x: x.isNotNull()), a))


def positive_alde(p: Column, g: Column) -> Column:
    """Absolute difference of logarithms of two positive numbers."""
    return F.when((p > 0) & (g > 0), F.abs(F.ln(p) - F.ln(g)))


def positive_min_ratio(p: Column, g: Column) -> Column:
    """The smaller of p/g and g/p of two positive numbers."""
    return F.when((p > 0) & (g > 0), F.least(F.try_divide(p, g), F.try_divide(g, p)))


def absolute_error(p: Column, g: Column) -> Column:
    return F.abs(p - g)


def in_range(x: Column, lo, hi) -> Column:
    return x.between(lo, hi)


def hv_to_pa(h: Column) -> Column:
    """Vickers hardness to pascal."""
    return h * 9.807e6


def gpa_to_pa(e: Column) -> Column:
    return e * 1e9


def canonical_interval(lo: Column, hi: Column) -> Column:
    """The absolute endpoints in order."""
    return F.struct(F.least(F.abs(lo), F.abs(hi)).alias("lo"), F.greatest(F.abs(lo), F.abs(hi)).alias("hi"))


def interval_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two canonical intervals; 1 or 0 for degenerate ones by whether they start alike."""
    inter = F.greatest(lit(0), F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"]))
    union = F.greatest(a["hi"], b["hi"]) - F.least(a["lo"], b["lo"])
    same = F.when(F.abs(a["lo"] - b["lo"]) <= 1e-12, lit(1)).otherwise(lit(0))
    return F.when(union <= 1e-12, same).otherwise(F.try_divide(inter, union))


def motion_range(kind: Column, lo: Column, hi: Column, rate: Column) -> Column:
    """Degrees to radians for hinges (C), source units times rate for slides (B); five places."""
    turn = lambda x: F.when(kind == "C", F.radians(x)).when(kind == "B", x * rate)
    return F.array(F.round(turn(lo), 5), F.round(turn(hi), 5))


def flip_range(r: Column) -> Column:
    """The range of the reversed axis."""
    return F.array(-r[1], -r[0])


def infer_seqlen(source: Column, target: Column, cutoff: Column) -> tuple[Column, Column]:
    """Lengths that source and target are cut to, in proportion where both are long."""
    half = target * 2 < cutoff
    short = source * 2 < cutoff
    most = F.when(half, cutoff).when(short, cutoff - source).otherwise(F.floor(cutoff * (F.try_divide(target, source + target))))
    kept = F.least(most, target)
    return F.least(F.greatest(cutoff - kept, F.lit(0)), source).cast("long"), kept.cast("long")


def longest_side(width: Column, height: Column, cap: int = 1280) -> Column:
    """Size with its longest side cut to cap, in proportion."""
    scale = F.least(lit(1), lit(cap) / F.greatest(width, height))
    return F.struct(F.floor(width * scale).cast("long").alias("w"), F.floor(height * scale).cast("long").alias("h"))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2 of two arrays."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), lit(0), lambda s, x: s + x)
    return (1 - F.try_divide(dot, norm(a) * norm(b))) / 2


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, lit(0), lambda s, x: s + x.cast("double") * x))


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a seed and keys: the first 52 bits of an MD5; the same for the same keys wherever they are computed."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
