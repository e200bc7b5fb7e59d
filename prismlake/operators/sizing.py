"""Searches for the level or quality that meets a size.

Sizes never grow with the level and never shrink with the quality, so the searches
that ask a function for one size at a time (on the driver, as each question depends
on the last answer) find the same optimum as the set-based forms, which answer for
all images at once from a sweep.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec_math as m
from ..functions.tables import INCREMENTS, int_array
from .blocks import CHANNELS

#: No quantizer grows beyond this level, the last round of steps.
LAST_LEVEL = 64 * 254


def first_level(ratio: float) -> float:
    """Estimate of the level that reaches a ratio."""
    # Ratios 5 and 15 bound three straight lines.
    if ratio < 5:
        return 1.25 * (ratio - 1)
    return 2.0 * (ratio - 1) if ratio < 15 else 1.5 * (ratio - 1) + 10


def search_level(size_at: Callable[[int], float], original: float, target: float, most: int = LAST_LEVEL) -> tuple[int, float]:
    """(level, size) of the smallest level within the target; where none is, of ``most``.

    From the ratio's estimate, strides that double find one level above the target's size
    and one within it; then the chord between their sizes and halving take turns at
    narrowing the two until they are neighbours.  No level is asked for twice.
    """
    size = cache(size_at)
    at = min(most, max(0, round(first_level(original / target))))
    over, within, stride = -1, most, max(1, at // 8)
    if size(at) <= target:
        within = at
        while within > 0 and over < 0:
            probe = max(0, within - stride)
            over, within, stride = (probe, within, stride) if size(probe) > target else (over, probe, 2 * stride)
    else:
        over = at
        while over < most:
            probe = min(most, over + stride)
            if size(probe) <= target:
                within = probe
                break
            over, stride = probe, 2 * stride
    halve = False
    while within - over > 1 and over >= 0:
        middle = (over + within) // 2
        if not halve and size(over) > size(within):
            middle = over + math.ceil((size(over) - target) / (size(over) - size(within)) * (within - over))
        middle = min(max(middle, over + 1), within - 1)
        over, within = (middle, within) if size(middle) > target else (over, middle)
        halve = not halve
    return within, size(within)


def search_quality(size_at: Callable[[float], float], limit: float, least: int = 10) -> tuple[float, float]:
    """(quality, size) of the best quality, in hundredths from ``least`` to 100, within the limit; the least one where none is."""
    size = cache(size_at)
    steps = range(least, 101)
    fitting = bisect_right(steps, limit, key=lambda q: size(q / 100))
    quality = steps[max(0, fitting - 1)] / 100
    return quality, size(quality)


def vanishing_level(c: Column, pos: Column, rank: Column) -> Column:
    """The smallest level at which a coefficient is quantized to 0, beyond LAST_LEVEL if none.

    It stays above 0 while its quantizer is at most 2c, or below -2c where c is negative;
    the step that passes that bound comes in a certain round, at the coefficient's rank.
    """
    bound = F.when(c > 0, F.floor(2 * c)).otherwise(F.ceil(-2 * c) - 1)
    steps = F.floor((bound - 1) / F.get(int_array(INCREMENTS), pos)) + 1
    return F.when(bound < 1, F.lit(0)).when(bound >= 255, F.lit(LAST_LEVEL + 1)).otherwise(64 * (steps - 1) + rank + 1).cast("int")


def all_levels(blocks: DataFrame, device: str, order: Column, most: int = 1000, key: str = "image_id") -> DataFrame:
    """Sizes of every image at every level up to ``most``: key, level, size, blocks; from rows key and c (64 coefficients).

    Each coefficient is looked at once: images' sizes follow from how many have vanished up to a level.
    """
    from pyspark.sql.window import Window

    spark = blocks.sparkSession
    own = spark.range(1).select(order.alias("o")).select(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.array_position("o", p).cast("int") - 1).alias("rank"))
    gone = F.transform("c", lambda c, p: F.least(F.lit(most + 1), vanishing_level(c, p, F.get("rank", p))))
    each = blocks.join(F.broadcast(own)).select(key, F.posexplode(gone).alias("p", "level"))  # one row
    counts = each.groupBy(key, "level").agg(F.count("*").alias("n"), F.count_if(F.col("p") == 0).alias("k"))
    total = counts.groupBy(key).agg(F.sum("k").alias("blocks"))
    grid = total.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(most))))
    lost = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(key).orderBy("level"))
    left = 64 * F.col("blocks") - lost
    return grid.join(counts.drop("k"), [key, "level"], "left").select(key, "level", (F.lit(21 + len(device)) + 10 * F.col("blocks") + 3 * left).cast("long").alias("size"), "blocks")


def sampled_search(codec, pixels: DataFrame, image_id: str, device: str, target: float, sample: int = 100, seed: int = 0) -> tuple[int, float, DataFrame]:
    """(level, estimate, copy): the level whose size estimated from sampled blocks is within the target, and the whole image at that level."""
    spark = pixels.sparkSession
    one = pixels.filter(F.col("image_id") == image_id)
    request = lambda level: spark.createDataFrame([(image_id, 0, device, level)], "image_id string, device_ord int, device_id string, level int")
    size_at = lambda level: sampled_size(codec.compress(one, request(level)), sample, seed).first()["size"]
    level, size = search_level(size_at, 3 * one.count(), target)
    return level, size, codec.compress(one, request(level))


def smallest_level(sweep: DataFrame, target: float, key: str = "image_id") -> DataFrame:
    """Per key, the smallest level of a sweep (key, level, size) whose size is within the target."""
    return sweep.filter(F.col("size") <= target).groupBy(key).agg(F.min("level").alias("level"), F.min_by("size", "level").alias("size"))


def largest_quality(sweep: DataFrame, limit: float, key: str = "image_id") -> DataFrame:
    """Per key, the best quality of a sweep whose size is within the limit; of sizes of one quality the largest."""
    best = sweep.filter(F.col("size") <= limit).groupBy(key).agg(F.max(F.struct("quality", "size")).alias("b"))
    return best.select(key, "b.quality", "b.size")


def sampled_size(compressed: DataFrame, sample: int = 100, seed: int = 0, unbiased: bool = True) -> DataFrame:
    """Size estimates of copies from ``sample`` of their blocks, drawn by a seeded hash (a sampling operator).

    Copies of at most twice as many blocks are counted whole.  ``unbiased``
    averages over the sampled blocks; otherwise a block counts if it has data.
    """
    from pyspark.sql.window import Window

    copy = ["image_id", "device_ord", "device_id", "level"]
    n = sum((m.nonzeros(F.col(c)) for c in CHANNELS), F.lit(0))
    rows = compressed.select(*copy, "px", "py", n.alias("n"))
    total = rows.groupBy(*copy).agg(F.count("*").alias("blocks"))
    drawn = rows.withColumn("r", F.row_number().over(Window.partitionBy(*copy).orderBy(F.xxhash64("px", "py", F.lit(seed)), "px", "py"))).join(total, copy)
    used = drawn.filter((F.col("r") <= sample) | (F.col("blocks") <= 2 * sample))
    head = F.lit(21) + F.length("device_id") + 10 * F.col("blocks")
    out = used.groupBy(*copy, "blocks").agg(F.sum("n").alias("s"), F.count("*").alias("k"), F.count_if(F.col("n") > 0).alias("d"))
    mean = F.col("s") / (F.col("k") if unbiased else F.greatest("d", F.lit(1)))
    return out.select(*copy, F.when(F.col("k") == F.col("blocks"), head + 3 * F.col("s")).otherwise(F.floor(head + mean * F.col("blocks") * 3 + 0.5)).cast("long").alias("size"))
