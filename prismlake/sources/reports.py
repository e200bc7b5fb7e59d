"""Sinks of the analyses: CSV, JSON and a Markdown summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import fixed


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    out = df.write.mode("overwrite").option("header", True)
    (out.partitionBy(by) if by else out).csv(path)


def write_json(analyses: DataFrame, path: str, key: str = "image_id") -> None:
    """One object per image with its points, in order of level, and one whose ``summary`` maps each level to its mean ratio."""
    rest = [c for c in analyses.columns if c != key]
    points = F.sort_array(F.collect_list(F.struct(*sorted(rest, key=lambda c: c != "level"))))
    images = analyses.groupBy(key).agg(points.alias("points"))
    analyses_out = images.unionByName(summary(analyses), allowMissingColumns=True) if "ratio" in rest else images
    analyses_out.write.mode("overwrite").json(path)


def summary(analyses: DataFrame) -> DataFrame:
    """One row: ``summary``, the mean ratio by level.  There are as many levels as the sweep has."""
    by = analyses.groupBy("level").agg(F.avg("ratio").alias("ratio"))
    return by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "ratio")))).alias("summary"))


def pivot_grid(matrix: DataFrame, value: str = "value") -> DataFrame:
    """An 8x8 grid from rows row, col and a value."""
    return matrix.groupBy("row").pivot("col", list(range(8))).agg(F.first(value)).orderBy("row")


def read_matrix(spark: SparkSession, path: str, device: str, level: int, most: int = 32) -> DataFrame:
    """The first ``most`` rows, in the device's order, of one device's matrix at a level, from CSV files of matrix rows."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rows.filter((F.col("device_id") == device) & (F.col("level") == level)).orderBy("order_index").limit(most)


def markdown(sweep: DataFrame) -> DataFrame:
    """Lines (image_id, line_no, line) of a report: image by image its name, size and extremes, then a line a level.

    Rows of the sweep: image_id, width, height, level, size, ratio, psnr.
    """
    kb = lambda c, d=1: fixed(c / 1024, d)
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    own = sweep.groupBy("image_id").agg(F.first("width").alias("w"), F.first("height").alias("h"), F.min("size").alias("least"), F.max("ratio").alias("most"))
    resolution = F.concat(F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string"))
    title = cells("image_id", resolution, F.concat(kb(F.col("w") * F.col("h") * 3), F.lit(" KB")), F.concat(kb(F.col("least")), F.lit(" KB")), F.concat(fixed(F.col("most"), 1), F.lit(":1")))
    head = own.select("image_id", F.posexplode(F.array(F.concat(F.lit("### "), F.col("image_id").cast("string")), title, F.lit("| level | KB | ratio | bits a pixel | PSNR |"), F.lit("| --- | --- | --- | --- | --- |"))).alias("line_no", "line"))
    line = cells(F.col("level").cast("string"), kb(F.col("size")), F.concat(fixed(F.col("ratio"), 1), F.lit(":1")), fixed(F.col("size") * 8 / (F.col("width") * F.col("height"))), fixed(F.col("psnr")))
    return head.unionByName(sweep.select("image_id", (F.col("level") + 4).alias("line_no"), line.alias("line")))


def write_markdown(sweep: DataFrame, path: str) -> None:
    """The report as text files, in order of image and line; images are dealt by range, so no task holds all."""
    lines = markdown(sweep).repartitionByRange("image_id").sortWithinPartitions("image_id", "line_no")
    lines.select("line").write.mode("overwrite").text(path)
