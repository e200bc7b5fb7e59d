"""Image files as pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PIXELS = ("image_id", "x", "y", "r", "g", "b")


def shrink(pixels: np.ndarray, longest: int | None) -> np.ndarray:
    """An image (height, width, channels) scaled so that its longer side is at most ``longest``, each pixel the mean of the area it covers.

    Sides are rounded down, 1 at least.
    """
    high, wide = pixels.shape[:2]
    if longest is None or max(high, wide) <= longest:
        return pixels
    out = pixels.astype(np.float64)
    for axis, side in ((0, high), (1, wide)):
        new = max(1, side * longest // max(high, wide))
        edge = np.arange(new + 1) * (side / new)
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        whole = np.minimum(edge.astype(int), side - 1)
        part = (edge - whole).reshape([-1 if k == axis else 1 for k in range(3)])
        upto = sums.take(whole, axis) + part * out.take(whole, axis)
        out = np.diff(upto, axis=axis) * (new / side)
    return np.floor(np.clip(out, 0, 255) + 0.5).astype(np.uint8)


def read_images(spark: SparkSession, path: str, pattern: str | None = None, most: int | None = None, longest: int | None = None) -> DataFrame:
    """Pixels of JPEG and PNG files; ``pattern`` filters file names, ``most`` keeps the first so many by name,
    ``longest`` scales larger images down to that side.

    Files that are no images drop out.  The reader's bytes are blue, green, red, (alpha) row by row.
    """
    source = spark.read.format("image").option("dropInvalid", True)
    if pattern or most is not None:
        name = F.regexp_extract("path", "[^/]+$", 0)
        names = spark.read.format("binaryFile").load(path).select("path", name.alias("n"))
        names = names.filter(F.col("n").rlike(pattern)) if pattern else names
        if most is not None:
            wanted = [r["path"] for r in names.orderBy("n").limit(most).collect()]
            if not wanted:
                return spark.createDataFrame([], "image_id string, x long, y long, r int, g int, b int")
            found = source.load(wanted)
        else:
            found = source.load(path).filter(F.regexp_extract("image.origin", "[^/]+$", 0).rlike(pattern))
    else:
        found = source.load(path)
    rows = found.select(F.regexp_extract("image.origin", "[^/]+$", 0).alias("image_id"), "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, wide, high, channels, data in zip(*[batch.column(c).to_pylist() for c in ("image_id", "width", "height", "nChannels", "data")], strict=True):
                bgr = shrink(np.frombuffer(data, np.uint8).reshape(high, wide, channels), longest)
                high, wide = bgr.shape[:2]
                rgb = [bgr[..., k] for k in ((0, 0, 0) if channels == 1 else (2, 1, 0))]
                step = max(1, 500_000 // wide)
                for top in range(0, high, step):
                    lines = min(step, high - top)
                    x, y = np.tile(np.arange(wide), lines), np.repeat(np.arange(top, top + lines), wide)
                    own = pa.DictionaryArray.from_arrays(np.zeros(lines * wide, np.int32), pa.array([name])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([own, pa.array(x, pa.int64()), pa.array(y, pa.int64()), *[pa.array(c[top : top + lines].ravel().astype(np.int32)) for c in rgb]], list(_PIXELS))

    return rows.mapInArrow(run, "image_id string, x long, y long, r int, g int, b int")
