"""Colours of points and pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(x: Column) -> Column:
    return x / 127.5 - 1


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.587 * g + 0.114 * b


def over_white(x: Column, alpha: Column) -> Column:
    return alpha * x + (1 - alpha) * 255


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """[hue in 0..1, saturation, value] of 0..255 channels."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    side = F.when(hi == r, F.try_divide(g - b, d)).when(hi == g, 2 + F.try_divide(b - r, d)).otherwise(4 + F.try_divide(r - g, d))
    return F.array(F.coalesce(F.pmod(side / 6, F.lit(1.0)), F.lit(0.0)), F.coalesce(F.try_divide(d, hi), F.lit(0.0)), hi)


def hsv_to_rgb(hsv: Column) -> Column:
    """Channels in 0..1."""
    h, s, v = hsv[0], hsv[1], hsv[2]

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.array(channel(5), channel(3), channel(1))
