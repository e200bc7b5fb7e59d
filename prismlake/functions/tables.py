"""Fixed 8x8 tables and the transform basis."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each compression step adds to a coefficient's quantizer, row by row.
INCREMENTS = (
    4, 3, 3, 4, 5, 8, 10, 12,
    3, 3, 4, 5, 6, 11, 12, 11,
    4, 4, 5, 6, 8, 11, 14, 11,
    4, 5, 6, 7, 10, 17, 16, 12,
    5, 6, 9, 11, 14, 22, 21, 15,
    6, 9, 11, 13, 16, 21, 23, 18,
    10, 13, 16, 17, 21, 24, 24, 20,
    14, 18, 19, 20, 22, 20, 21, 20,
)

# The luminance quantizers that device matrices vary, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)


def zigzag() -> list[int]:
    """Row-major positions in zigzag order: anti-diagonals, odd ones downward, even ones upward."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))
    return [8 * r + c for r, c in cells]


ZIGZAG = zigzag()
UNZIGZAG = [ZIGZAG.index(p) for p in range(64)]


@cache
def waves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column cosines (64 samples 8x + y by 64 coefficients 8u + v each) and the coefficients' scales."""
    wave = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8)] for x in range(8)])
    norm = [1 / math.sqrt(2)] + [1.0] * 7
    rows = np.repeat(np.repeat(wave, 8, axis=0), 8, axis=1)
    columns = np.tile(wave, (8, 8))
    return rows, columns, np.array([((2 / 8) * norm[u]) * norm[v] for u in range(8) for v in range(8)])


@cache
def basis() -> np.ndarray:
    """64 x 64: coefficient (8u + v) of sample (8x + y) in the orthonormal 2-D transform."""
    rows, columns, scale = waves()
    return (rows * columns).T * scale[:, None]


def int_array(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def positions(spark: SparkSession) -> DataFrame:
    """The 64 positions: pos, row, col, inc, zig (place in zigzag order), band."""
    pos = F.col("id").cast("int")
    row, col = F.floor(pos / 8).cast("int"), (pos % 8).cast("int")
    return spark.range(64).select(
        pos.alias("pos"), row.alias("row"), col.alias("col"),
        F.get(int_array(INCREMENTS), pos).alias("inc"), F.get(int_array(UNZIGZAG), pos).alias("zig"), band(row, col).alias("band"),
    )


def band(row: Column, col: Column) -> Column:
    """Frequency band by distance from the corner."""
    return F.when(row + col <= 3, "low").when(row + col <= 8, "mid").otherwise("high")
