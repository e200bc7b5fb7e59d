"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .textkernel import slices

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset on one machine (tests), one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="prismlake-"))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts lineage: the table written to the shared folder and read again, and its path."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker hands the memory that its task freed back to the system.

    Workers live on from task to task, and what they keep would add up with what other operators' tasks need.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # another C library
            pass

    return tidied


def met(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and in ``c`` the number of rows with it.

    Keys with more than a thousandth of all ``total`` rows, fewer than 1000, are met by broadcast;
    the others in a join by key.
    """
    hot = F.col("c") * 1000 > total
    most, rest = table.filter(hot).drop("c"), table.filter(~hot).drop("c")
    return rows.join(F.broadcast(most), keys).unionByName(rows.join(F.broadcast(most.select(keys)), keys, "left_anti").join(rest, keys, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_in_order(df: DataFrame, bits: int) -> DataFrame:
    """Rows dealt by their ``bucket`` of ``bits`` bits, each partition an equal range of buckets, and sorted by it."""
    parts = partitions(df.sparkSession)
    return df.repartitionById(parts, F.expr(f"cast(shiftright(cast(bucket as bigint) * {parts}, {bits}) as int)")).sortWithinPartitions("bucket")


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that no later result reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def add_columns(df: DataFrame, text: str, fields: list[StructField], make: Callable[[pa.Array], list[pa.Array]], drop: tuple[str, ...] = (), prepare: Callable[[], object] | None = None) -> DataFrame:
    """Appends columns computed from a text column in Arrow batches of a few MB of text.

    Other columns stay, except those in ``drop`` and those named like a new one.
    """
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names, spare = [f.name for f in keep], text in new or text in drop
    source = df.select(*[f"`{n}`" for n in names], *([df[text].alias("__text")] if spare else []))
    column = "__text" if spare else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *make(part.column(column))], [*names, *[f.name for f in fields]])

    return source.mapInArrow(tidy(run), StructType([*keep, *fields]))
