"""Scalar formulas of the codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_half_up, to_byte


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    cb = F.lit(128) - F.lit(0.168736) * r - F.lit(0.331264) * g + F.lit(0.5) * b
    cr = F.lit(128) + F.lit(0.5) * r - F.lit(0.418688) * g - F.lit(0.081312) * b
    return luma(r, g, b), cb, cr


def rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    r = y + F.lit(1.402) * (cr - 128)
    g = y - F.lit(0.344136) * (cb - 128) - F.lit(0.714136) * (cr - 128)
    b = y + F.lit(1.772) * (cb - 128)
    return to_byte(r), to_byte(g), to_byte(b)


def level_of_quality(q: Column) -> Column:
    return round_half_up((F.lit(1.0) - q) * 63).cast("int")


def quality_of_level(level: Column, floor: float = 0.01) -> Column:
    return F.greatest(F.lit(floor), F.lit(1.0) - F.least(level, F.lit(63)) / F.lit(63.0))


def level_of_ratio(ratio: Column) -> Column:
    """First guess of the level that reaches a compression ratio."""
    r = ratio - 1
    return F.when(ratio < 5, F.lit(1.25) * r).when(ratio < 15, F.lit(2.0) * r).otherwise(F.lit(1.5) * r + 10)


def quantize(c: Column, q: Column) -> Column:
    return round_half_up(c / q).cast("int")


def gray_step(quality: Column) -> Column:
    """Width of a gray level of the run-length codec."""
    return F.lit(256.0) / round_half_up(2 + quality * 254)


def quantize_gray(gray: Column, quality: Column) -> Column:
    step = gray_step(quality)
    return F.floor(gray / step) * step


def ladder_quantizer(quality: Column, row: Column, col: Column, device_q: Column) -> Column:
    """Quantizer of the DCT codec: light fixed ramps at high quality, else the device's matrix scaled."""
    ramp = lambda base, step, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.lit(base) + F.lit(step) * (row + col))).cast("double")
    dc = (row == 0) & (col == 0)
    multiplier = F.when(dc, 1 + (1 - quality) * 2).otherwise(1 + (1 - quality) * 9)
    scaled = F.greatest(F.lit(1.0), round_half_up(device_q * multiplier * 0.5))
    return F.when(quality >= 0.95, ramp(8, 2, 4, 16)).when(quality >= 0.85, ramp(12, 3, 8, 24)).when(quality >= 0.75, ramp(16, 4, 12, 32)).otherwise(scaled).cast("int")


def keeps(quality: Column, zig: Column, mask: Column) -> Column:
    """Whether the DCT codec keeps a zigzag position."""
    return (quality >= 0.95) | ((quality >= 0.85) & (zig < 48)) | ((quality >= 0.75) & (zig < 32)) | mask


def wavelet_factor(quality: Column) -> Column:
    return 1 + (1 - quality) * 50


def wavelet_quantize(v: Column, quality: Column, threshold: Column) -> Column:
    f = wavelet_factor(quality)
    return F.when(F.abs(v) < f * (1 + threshold), F.lit(0.0)).otherwise(round_half_up(v / f) * f)


def bit_length(c: Column) -> Column:
    """Bits that the absolute value of a nonzero integer takes."""
    return F.length(F.bin(F.abs(c).cast("long")))


def dct_block_bytes(coefficients: Column) -> Column:
    """Size model of one channel's coefficients: 2 bytes a nonzero and its bits."""
    return F.aggregate(F.filter(coefficients, lambda c: c != 0), F.lit(0.0), lambda s, c: s + 2 + bit_length(c) / F.lit(8.0))


def nonzeros(coefficients: Column) -> Column:
    return F.size(F.filter(F.coalesce(coefficients, F.array().cast("array<int>")), lambda c: c != 0))


def psnr(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(65025.0) / mse))


def heat_class(value: Column) -> Column:
    return F.when(value == 1, "low").when(value < 20, "medium").otherwise("high")


def print_class(value: Column) -> Column:
    """The four classes in which a matrix is printed."""
    return F.when(value == 1, "one").when(value < 10, "low").when(value < 20, "medium").otherwise("high")


def difference_byte(a: Column, b: Column) -> Column:
    """Difference made visible: five times, 255 at most."""
    return F.least(F.lit(255), 5 * F.abs(a - b))
