"""Codes of grid cells and positional encodings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .numeric import lit


def zorder(x: Column, y: Column, z: Column, depth: int = 16) -> Column:
    """Bits of x, y and z interleaved, x highest; built from integer arithmetic only."""
    code = F.lit(0).cast("long")
    for b in range(depth):
        for shift, v in ((2, x), (1, y), (0, z)):
            bit = F.shiftright(v.cast("long"), b).bitwiseAND(F.lit(1))
            code = code.bitwiseOR(F.shiftleft(bit, 3 * b + shift))
    return code


def zorder_decode(code: Column, depth: int = 16) -> Column:
    def axis(shift: int) -> Column:
        out = F.lit(0).cast("long")
        for b in range(depth):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 3 * b + shift).bitwiseAND(F.lit(1)), b))
        return out

    return F.struct(axis(2).alias("x"), axis(1).alias("y"), axis(0).alias("z"))


def gray(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 1))


def gray_inverse(g: Column, bits: int = 32) -> Column:
    """Prefix xor, by doubling shifts."""
    shift = 1
    while shift < bits:
        g = g.bitwiseXOR(F.shiftright(g, shift))
        shift *= 2
    return g


def hilbert_codes(cells: np.ndarray, depth: int) -> np.ndarray:
    """Hilbert indices of an (n, 3) array of cells: transpose form by bit planes, then bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(3):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, 3):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where(x[2] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    code = np.zeros_like(x[0])
    for b in range(depth):
        for i in range(3):
            code |= ((x[i] >> b) & 1) << (3 * b + 2 - i)
    return code


def hilbert_cells(code: np.ndarray, depth: int) -> np.ndarray:
    """Cells of Hilbert indices."""
    code = code.astype(np.int64)
    x = np.zeros((3, len(code)), np.int64)
    for b in range(depth):
        for i in range(3):
            x[i] |= ((code >> (3 * b + 2 - i)) & 1) << b
    t = x[2] >> 1
    for i in (2, 1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q != 1 << depth:
        p = q - 1
        for i in (2, 1, 0):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q <<= 1
    return x.T


def hilbert(x: Column, y: Column, z: Column, depth: int = 16) -> Column:
    """Hilbert index of a cell; 48 dependent steps, so one vectorised function on Arrow batches."""

    @pandas_udf("long")
    def code(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c in parts:
            yield pd.Series(hilbert_codes(np.stack([a, b, c], 1), depth))

    return code(x, y, z)


def cell_order(x: Column, y: Column, z: Column, order: str, depth: int = 16) -> Column:
    """Code by the name of an order: z, z-trans, hilbert, hilbert-trans; the latter of each swap x and y."""
    a, b = (y, x) if order.endswith("-trans") else (x, y)
    if order.startswith("hilbert"):
        return hilbert(a, b, z, depth)
    if order.startswith("z"):
        return zorder(a, b, z, depth)
    raise ValueError(f"no such order: {order}")


def ravel(x: Column, y: Column, z: Column, my: Column, mz: Column) -> Column:
    """Mixed-radix key of a cell; my and mz are the greatest coordinates."""
    return (x * (my + 1) + y) * (mz + 1) + z


#: Offset basis and prime of the 64-bit hash, multiplied before xor.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv_hash(x: Column, y: Column, z: Column) -> Column:
    """Unsigned 64-bit FNV of three small non-negative integers, as decimal(20,0): products modulo 2^64, xor on the low half."""
    wide = "decimal(20,0)"
    h = F.lit(str(FNV_BASIS)).cast(wide)
    two32 = F.lit(str(1 << 32)).cast(wide)
    for v in (x, y, z):
        # h * prime mod 2^64 from 32-bit halves, each product below 2^74
        hi, lo = F.floor(h / two32).cast(wide), (h % two32).cast(wide)
        prime = F.lit(str(FNV_PRIME)).cast("decimal(13,0)")
        low = (lo * prime).cast("decimal(38,0)")
        high = ((hi * prime) % two32).cast(wide)
        total = (high.cast("decimal(38,0)") * two32 + low) % F.lit(str(1 << 64)).cast("decimal(38,0)")
        top = F.floor(total / two32).cast(wide)
        bottom = (total % two32).cast("long").bitwiseXOR(v.cast("long"))
        h = (top.cast("decimal(38,0)") * two32 + bottom.cast(wide)).cast(wide)
    return h


def fourier(v: Column, bands: int = 4, rate: float = 8.0) -> Column:
    """[v, sin and cos of v at evenly spaced frequencies]."""
    steps = [1 + (rate / 2 - 1) * k / (bands - 1) for k in range(bands)]
    return F.array(v, *[F.sin(v * lit(math.pi * f)) for f in steps], *[F.cos(v * lit(math.pi * f)) for f in steps])


def sine_position(pos: Column, dim: int = 8, base: float = 10000.0) -> Column:
    """Sine and cosine of a position over powers of base."""
    return F.array(*[(F.sin if k % 2 == 0 else F.cos)(pos / lit(base ** (2 * (k // 2) / dim))) for k in range(dim)])


def serialised(points: DataFrame, order: str, depth: int = 16) -> DataFrame:
    """points (batch, idx, gx, gy, gz) with code and position in each batch's order."""
    from pyspark.sql import Window

    code = cell_order(F.col("gx"), F.col("gy"), F.col("gz"), order, depth)
    return points.withColumn("code", code).withColumn(
        "position", F.row_number().over(Window.partitionBy("batch").orderBy("code", "idx")) - 1
    )
