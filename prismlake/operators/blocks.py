"""8x8 blocks: cutting images into blocks and back, the cosine and Haar transforms, zigzag order.

Relations::

    pixel   (image_id, x, y, r, g, b)                       long form of an image
    block   (image_id, width, height, px, py, y, cb, cr)    arrays of 64 doubles, row by row
    band    (image_id, band, y, x, v)                        one level of Haar sub-bands

Blocks don't depend on one another, so every step but the grouping of pixels is
a map.  The cosine transform multiplies Arrow batches by the 64x64 basis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.codec_math import luma, rgb, ycbcr
from ..functions.tables import UNZIGZAG, ZIGZAG, basis, int_array, waves

CHANNELS = ("y", "cb", "cr")


def block_count(width: int, height: int) -> int:
    return -(-width // 8) * -(-height // 8)


def to_blocks(pixels: DataFrame) -> DataFrame:
    """Blocks of centred Y, Cb and Cr samples; samples beyond the image are 0 (mid-grey)."""
    lum, cb, cr = ycbcr(F.col("r"), F.col("g"), F.col("b"))
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    sample = F.struct(((F.col("y") % 8) * 8 + F.col("x") % 8).cast("int").alias("p"), (lum - 128).alias("sy"), (cb - 128).alias("scb"), (cr - 128).alias("scr"))
    placed = pixels.select("image_id", (F.col("x") - F.col("x") % 8).alias("px"), (F.col("y") - F.col("y") % 8).alias("py"), sample.alias("s"))
    found = placed.groupBy("image_id", "px", "py").agg(F.sort_array(F.collect_list("s")).alias("s"))

    def channel(name: str) -> Column:
        padded = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.get(F.filter("s", lambda t: t["p"] == i), F.lit(0))[name], F.lit(0.0)))
        return F.when(F.size("s") == 64, F.transform("s", lambda t: t[name])).otherwise(padded)

    return found.join(sizes, "image_id").select("image_id", "width", "height", "px", "py", *[channel(f"s{c}").alias(c) for c in CHANNELS])


def to_pixels(blocks: DataFrame) -> DataFrame:
    """Pixels of blocks of centred samples, cut at the image's edges; other columns of the block stay."""
    keys = [c for c in blocks.columns if c not in (*CHANNELS, "px", "py", "width", "height")]
    zipped = blocks.select("*", F.posexplode(F.arrays_zip(*CHANNELS)).alias("__p", "__s"))
    r, g, b = rgb(F.col("__s.y") + 128, F.col("__s.cb") + 128, F.col("__s.cr") + 128)
    out = zipped.withColumns({"__x": F.col("px") + F.col("__p") % 8, "__y": F.col("py") + F.floor(F.col("__p") / 8)}).filter("__x < width AND __y < height")
    return out.select(*keys, F.col("__x").alias("x"), F.col("__y").cast("long").alias("y"), r.alias("r"), g.alias("g"), b.alias("b"))


def _forward(flat: np.ndarray) -> np.ndarray:
    """Coefficients of rows of 64 samples.

    Each sample times its row and its column cosine, summed sample by sample and
    scaled last: coefficients halfway between two quantized values then fall as
    they do in a plain loop, whatever the batch.
    """
    rows, columns, scale = waves()
    out = np.zeros((len(flat), 64))
    for k in range(64):
        out += flat[:, k : k + 1] * rows[k] * columns[k]
    return out * scale


def _inverse(flat: np.ndarray) -> np.ndarray:
    """Samples of rows of 64 coefficients, summed coefficient by coefficient, so that every machine gives the same."""
    out = np.zeros((len(flat), 64))
    for k in range(64):
        out += flat[:, k : k + 1] * basis()[k]
    return out


def _transformed(df: DataFrame, columns: tuple[str, ...], function, names: tuple[str, ...]) -> DataFrame:
    keep = [f for f in df.schema.fields if f.name not in columns and f.name not in names]
    schema = StructType([*keep, *[StructField(n, ArrayType(DoubleType())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(f.name) for f in keep]
            for c in columns:
                column = batch.column(c)
                valid = np.asarray(column.is_valid())
                out = np.zeros((len(column), 64))
                if valid.any():
                    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64)
                    out[valid] = function(flat)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * 64, pa.int32()), pa.array(out.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, [*[f.name for f in keep], *names])

    return df.mapInArrow(run, schema)


def dct(df: DataFrame, columns: tuple[str, ...] = CHANNELS, names: tuple[str, ...] | None = None) -> DataFrame:
    """Cosine transform of arrays of 64 samples; a null array counts as zeros."""
    return _transformed(df, columns, _forward, names or columns)


def inverse_dct(df: DataFrame, columns: tuple[str, ...] = CHANNELS, names: tuple[str, ...] | None = None) -> DataFrame:
    return _transformed(df, columns, _inverse, names or columns)


def dct_by_join(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The transform as a join with the basis (4096 rows) and a sum: rows keys, pos, v give keys, k, c."""
    spark = samples.sparkSession
    table = spark.createDataFrame([(int(k), int(p), float(basis()[k, p])) for k in range(64) for p in range(64)], "k int, pos int, w double")
    return samples.join(F.broadcast(table), "pos").groupBy(*keys, "k").agg(F.sum(F.col("v") * F.col("w")).alias("c"))


def zigzag(block: Column) -> Column:
    return F.transform(int_array(ZIGZAG), lambda p: F.get(block, p))


def unzigzag(line: Column) -> Column:
    """Row-by-row order; a null line counts as zeros."""
    full = F.coalesce(line, F.array_repeat(F.lit(0), 64))
    return F.transform(int_array(UNZIGZAG), lambda p: F.get(full, p))


def to_gray(pixels: DataFrame) -> DataFrame:
    return pixels.select(*[c for c in pixels.columns if c not in "rgb"], luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def haar(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One Haar level of rows keys, y, x, v: rows keys, band, y, x, v.  Odd last rows and columns drop out."""
    cell = ((F.col("y") % 2) * 2 + F.col("x") % 2).cast("int")
    at = [F.max(F.when(cell == i, F.col("v"))) for i in range(4)]
    quads = samples.groupBy(*keys, F.floor(F.col("y") / 2).alias("qy"), F.floor(F.col("x") / 2).alias("qx")).agg(*[a.alias(n) for a, n in zip(at, "abcd", strict=True)], F.count("v").alias("n")).filter("n = 4")
    bands = {"LL": "a + b + c + d", "LH": "a - b + c - d", "HL": "a + b - c - d", "HH": "a - b - c + d"}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), (F.expr(f"({e}) / 4")).alias("v")) for n, e in bands.items()]))
    return quads.select(*keys, F.col("qy").alias("y"), F.col("qx").alias("x"), each.alias("s")).select(*keys, "s.band", "y", "x", "s.v")


def inverse_haar(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Rows keys, y, x, v of complete quads; an odd edge has no rows (it decodes as 0)."""
    value = lambda n: F.max(F.when(F.col("band") == n, F.col("v")))
    quads = bands.groupBy(*keys, "y", "x").agg(*[value(n).alias(n.lower()) for n in ("LL", "LH", "HL", "HH")])
    parts = [(0, 0, "ll + lh + hl + hh"), (0, 1, "ll - lh + hl - hh"), (1, 0, "ll + lh - hl - hh"), (1, 1, "ll - lh - hl + hh")]
    each = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.expr(e).alias("v")) for dy, dx, e in parts]))
    return quads.select(*keys, "y", "x", each.alias("s")).select(*keys, (F.col("y") * 2 + F.col("s.dy")).alias("y"), (F.col("x") * 2 + F.col("s.dx")).alias("x"), "s.v")
