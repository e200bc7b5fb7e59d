"""Quality, size, coverage and matrix statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codec_math as m
from ..functions import strategy as st
from ..functions.tables import INCREMENTS, band, int_array, positions


def psnr(original: DataFrame, decoded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """mse and psnr of decoded pixels per image (and the further columns ``keys`` of the decoded side).

    Alpha plays no part.  Fails where an image's pixels differ in number.
    """
    keys = ["image_id", *(keys or [])]
    o = original.select("image_id", "x", "y", *[F.col(c).alias(f"o{c}") for c in "rgb"])
    count = original.groupBy("image_id").agg(F.count("*").alias("n"))
    gap = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "rgb"), F.lit(0.0))
    out = decoded.join(o, ["image_id", "x", "y"], "left").groupBy(*keys).agg(F.sum(gap).alias("s"), F.count("or").alias("met"), F.count("*").alias("got"))
    same = (F.col("met") == F.col("n")) & (F.col("got") == F.col("n"))
    mse = F.when(same, F.col("s") / (3 * F.col("n"))).otherwise(F.raise_error(F.lit("images differ in size")).cast("double"))
    return out.join(count, "image_id").select(*keys, mse.alias("mse")).withColumn("psnr", m.psnr(F.col("mse")))


def difference_image(a: DataFrame, b: DataFrame) -> DataFrame:
    o = b.select("image_id", "x", "y", *[F.col(c).alias(f"o{c}") for c in "rgb"])
    return a.join(o, ["image_id", "x", "y"]).select("image_id", "x", "y", *[m.difference_byte(F.col(c), F.col(f"o{c}")).alias(c) for c in "rgb"])


def median_pixels(copies: DataFrame) -> DataFrame:
    """Median of each channel over the copies of an image."""
    return copies.groupBy("image_id", "x", "y").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in "rgb"])


def rate(size: Column, width: Column, height: Column) -> dict[str, Column]:
    """Kilobytes, compression ratio and bits a pixel of a compressed size."""
    return {"size_kb": size / 1024, "ratio": width * height * 3 / size, "bits_per_pixel": size * 8 / (width * height)}


def selection_order(devices: DataFrame) -> DataFrame:
    """Rows device_id, order_index, pos, row, col, frequency_band of the devices' orders."""
    e = devices.select("device_id", F.posexplode(st.quantization_order(F.col("device_id"))).alias("order_index", "pos"))
    row, col = F.floor(F.col("pos") / 8).cast("int"), (F.col("pos") % 8).cast("int")
    return e.select("device_id", "order_index", "pos", row.alias("row"), col.alias("col"), band(row, col).alias("frequency_band"))


def matrices(devices: DataFrame, levels: list[int]) -> DataFrame:
    """Rows device_id, level, pos, order_index, increment, value: the quantizers of each device at each level."""
    order = selection_order(devices)
    inc = F.get(int_array(INCREMENTS), F.col("pos"))
    return order.withColumn("level", F.explode(int_array(levels))).select(
        "device_id", "level", "pos", "row", "col", "order_index", inc.alias("increment"), st.quantizer(inc, F.col("order_index"), F.col("level")).alias("value")
    )


def matrix_statistics(mat: DataFrame) -> DataFrame:
    return mat.groupBy("device_id", "level").agg(F.avg("value").alias("avg_quantization"), F.min("value").alias("min_quantization"), F.max("value").alias("max_quantization"), F.stddev_pop("value").alias("std_deviation"))


def theoretical_ratio(mat: DataFrame) -> DataFrame:
    return mat.groupBy("device_id", "level").agg((F.lit(0.8) * F.avg("value")).alias("theoretical_ratio"), F.avg("value").alias("avg_quantization"))


def leading_quantizers(mat: DataFrame, most: int = 20) -> DataFrame:
    """The first min(most, level) coefficients of every device's order."""
    return mat.filter(F.col("order_index") < F.least(F.lit(most), F.col("level"))).select("device_id", "level", "order_index", F.col("pos").alias("coefficient_index"), F.col("value").alias("quantization_value"))


def mask_coverage(devices: DataFrame) -> DataFrame:
    """Per zigzag position, how many devices keep it."""
    return devices.select(F.posexplode(st.frequency_mask(F.col("device_id"))).alias("position", "kept")).groupBy("position").agg(F.count_if("kept").alias("devices"))


def mask_coverage_summary(devices: DataFrame) -> DataFrame:
    """One row: positions that some device keeps, and the mean, least and greatest number of devices a position."""
    return mask_coverage(devices).agg(F.count_if(F.col("devices") > 0).alias("covered"), F.avg("devices").alias("average"), F.min("devices").alias("least"), F.max("devices").alias("most"))


def increment_statistics(spark: SparkSession) -> DataFrame:
    """Mean, least and greatest of the steps by which quantizers grow."""
    return positions(spark).agg(F.avg("inc").alias("average"), F.min("inc").alias("least"), F.max("inc").alias("most"))


def walk_through(devices: DataFrame, first: int = 20, later: int = 40) -> DataFrame:
    """Per device, the mean step of the first ``first`` coefficients and the mean quantizers at the two levels."""
    mat = matrices(devices, [first, later])
    mean = lambda level: F.avg(F.when(F.col("level") == level, F.col("value")))
    step = F.avg(F.when((F.col("level") == first) & (F.col("order_index") < first), F.col("increment")))
    return mat.groupBy("device_id").agg(step.alias("avg_increment"), mean(first).alias("avg_first"), mean(later).alias("avg_later"))


def leading_rows(mat: DataFrame, most: int = 32) -> DataFrame:
    """The first ``most`` rows of each device and level in the device's order."""
    by = Window.partitionBy("device_id", "level").orderBy("order_index")
    return mat.withColumn("__r", F.row_number().over(by)).filter(F.col("__r") <= most).drop("__r")


def matrix_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two matrices (pos, value): positions where the first is larger, smaller, equal, and different."""
    j = a.select("pos", F.col("value").alias("va")).join(b.select("pos", F.col("value").alias("vb")), "pos")
    return j.agg(F.count_if(F.expr("va > vb")).alias("larger"), F.count_if(F.expr("va < vb")).alias("smaller"), F.count_if(F.expr("va = vb")).alias("equal"), F.count_if(F.expr("va <> vb")).alias("different"))


def increase(mat: DataFrame) -> DataFrame:
    """Percentage by which each quantizer exceeds the base of 1."""
    return mat.withColumn("increase_percent", (F.col("value") - 1) * 100.0)


def ratio_by_level(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("level").agg(F.avg("ratio").alias("avg_ratio"))


def extremes(sweep: DataFrame, key: str = "image_id") -> DataFrame:
    return sweep.groupBy(key).agg(F.min("size").alias("min_size"), F.max("ratio").alias("max_ratio"))


def file_bytes(device: Column, nonzeros: Column) -> Column:
    """Size of a coefficient file: 36 bytes, the identifier, 10 a block (included per row of ``nonzeros``), 3 a nonzero."""
    return F.lit(36) + F.octet_length(device) + nonzeros
