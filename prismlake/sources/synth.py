"""Synthetic images, as pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import store_byte


def grid(spark: SparkSession, width: int, height: int, image_id: str = "image") -> DataFrame:
    return spark.range(width * height).select(F.lit(image_id).alias("image_id"), (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))


def _bars(x: Column, width: int, count: int = 8) -> list[Column]:
    bar = F.least(F.floor(x / (width / count)), F.lit(count - 1)).cast("int")
    # White, yellow, cyan, green, magenta, red, blue, black.
    on = {"r": "11001100", "g": "11110000", "b": "10101010"}
    return [F.get(F.array(*[F.lit(int(v) * 255) for v in on[c]]), bar) for c in "rgb"]


def image(spark: SparkSession, pattern: str, width: int, height: int, image_id: str | None = None, seed: int = 0) -> DataFrame:
    """Pixels of a named pattern: solid, gradient, checkerboard, noise, rgb_gradient, checker_gradient,
    scene_gradient, scene_checkerboard, colorbars, circles, mixed."""
    x, y = F.col("x"), F.col("y")
    cell = lambda n: (F.floor(x / n) + F.floor(y / n)) % 2
    noise = lambda k: F.floor(F.rand(seed + k) * 256).cast("int")
    gradient = [store_byte(x * 255 / width), store_byte(y * 255 / height), F.lit(128)]
    if pattern == "solid":
        rgb = [F.lit(128)] * 3
    elif pattern == "gradient":
        rgb = [F.floor(x / width * 255).cast("int")] * 3
    elif pattern == "checkerboard":
        rgb = [(cell(8) * 255).cast("int")] * 3
    elif pattern == "noise":
        rgb = [noise(0)] * 3
    elif pattern == "rgb_gradient":
        rgb = gradient
    elif pattern == "checker_gradient":
        rgb = [F.when(cell(8) == 1, v).otherwise(g) for v, g in zip((255, 255, 128), gradient, strict=True)]
    elif pattern == "scene_gradient":
        rgb = [F.floor(x / width * 255), F.floor(y / height * 255), F.floor((x + y) / (width + height) * 255)]
    elif pattern == "scene_checkerboard":
        rgb = [F.when(cell(32) == 0, 255).otherwise(0)] * 3
    elif pattern == "colorbars":
        rgb = _bars(x, width)
    elif pattern == "circles":
        away = F.sqrt((x - width / 2) ** 2 + (y - height / 2) ** 2)
        rgb = [F.when(F.sin(away / 20) > 0, 255).otherwise(0)] * 3
    elif pattern == "mixed":
        left, top = x < width / 2, y < height / 2
        stripe = F.when(x % 16 < 8, 255).otherwise(0)
        rgb = [
            F.when(left & top, a).when(top, stripe).when(left, F.lit(c)).otherwise(noise(k))
            for k, (a, c) in enumerate(((F.floor(x / (width / 2) * 255), 64), (F.floor(y / (height / 2) * 255), 128), (F.lit(128), 192)))
        ]
    else:
        raise ValueError(f"unknown pattern {pattern!r}")
    return grid(spark, width, height, image_id or pattern).select("image_id", "x", "y", *[v.cast("int").alias(c) for v, c in zip(rgb, "rgb", strict=True)])
