"""Number conventions of the codecs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """Nearest integer, halves toward plus infinity; as double."""
    return F.floor(c + F.lit(0.5)).cast("double")


def clamp_byte(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))


def store_byte(c: Column) -> Column:
    """What a clamped byte array keeps of a number: halves go to even."""
    return F.bround(clamp_byte(c), 0).cast("int")


def to_byte(c: Column) -> Column:
    """Rounded half up, then clamped."""
    return clamp_byte(round_half_up(c)).cast("int")


def unsigned32(c: Column) -> Column:
    return F.pmod(c, F.lit(1 << 32))


def fixed(c: Column, digits: int = 2) -> Column:
    """Text with so many decimals, exact halves upward."""
    scale = 10**digits
    return F.format_string(f"%.{digits}f", F.floor(c * scale + F.lit(0.5)) / F.lit(float(scale)))


def size_text(c: Column) -> Column:
    """Bytes, kilobytes with one decimal or megabytes with two."""
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.concat(fixed(c / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(c / (1024 * 1024), 2), F.lit(" MB")))
    )
