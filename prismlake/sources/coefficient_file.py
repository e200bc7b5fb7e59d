"""The sparse coefficient file: one device's copy of one image.

Big-endian: magic, version, width, height, level, time stamp, original size and
identifier length (32 bits each), the identifier in UTF-8, the number of blocks
(32 bits); then per block x and y (16 bits each) and for Y, Cb and Cr the number
of nonzeros (16 bits) with a zigzag position (8 bits) and value (signed, 16 bits)
for each.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, VERSION, HEAD, MOST_ID = 0x4E534C00, 1, struct.Struct(">8I"), 100

BLOCK = "struct<px:int,py:int,y:array<int>,cb:array<int>,cr:array<int>>"
SCHEMA = f"device_id string, width int, height int, level int, blocks array<{BLOCK}>"


class FormatError(ValueError):
    """The bytes are not a coefficient file."""


def encode(device_id: str, width: int, height: int, level: int, blocks: list, timestamp: int = 0) -> bytes:
    name = device_id.encode()
    out = [HEAD.pack(MAGIC, VERSION, width, height, level, timestamp & 0xFFFFFFFF, width * height * 3 & 0xFFFFFFFF, len(name)), name, struct.pack(">I", len(blocks))]
    for b in blocks:
        out.append(struct.pack(">HH", b["px"] & 0xFFFF, b["py"] & 0xFFFF))
        for c in ("y", "cb", "cr"):
            some = [(i, v) for i, v in enumerate(b[c] if b[c] is not None else ()) if v]
            out.append(struct.pack(">H", len(some)))
            out += [struct.pack(">Bh", i, v) for i, v in some]
    return b"".join(out)


def decode(data: bytes) -> dict:
    """The file's content as a row of ``SCHEMA``; FormatError says what is wrong."""

    def need(at: int, n: int, what: str) -> None:
        if at + n > len(data):
            raise FormatError(f"the file ends within {what}")

    if len(data) < HEAD.size:
        raise FormatError("the file is too small for a header")
    magic, version, width, height, level, _, _, length = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise FormatError("the magic number is wrong")
    if version != VERSION:
        raise FormatError(f"version {version} is not known")
    if not 0 < length <= MOST_ID:
        raise FormatError(f"an identifier of {length} bytes is not allowed")
    at = HEAD.size
    need(at, length, "the identifier")
    name = data[at : at + length].decode()
    at += length
    need(at, 4, "the number of blocks")
    (count,) = struct.unpack_from(">I", data, at)
    at += 4
    blocks = []
    for _ in range(count):
        need(at, 4, "a block's position")
        px, py = struct.unpack_from(">HH", data, at)
        at += 4
        block: dict = {"px": px, "py": py}
        for c in ("y", "cb", "cr"):
            need(at, 2, f"channel {c}")
            (n,) = struct.unpack_from(">H", data, at)
            at += 2
            need(at, 3 * n, f"channel {c}")
            line = [0] * 64
            for i, v in struct.iter_unpack(">Bh", data[at : at + 3 * n]):
                if i > 63:
                    raise FormatError(f"position {i} in channel {c} is out of range")
                line[i] = v
            at += 3 * n
            block[c] = line
        blocks.append(block)
    return {"device_id": name, "width": width, "height": height, "level": level, "blocks": blocks}


def file_name(device: Column, level: Column, at: Column) -> Column:
    """Identifier, level and time (UTC, whatever the session's zone) as a file name."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(at))
    stamp = F.translate(utc.cast("string"), " :", "T-")
    return F.concat(device, F.lit("_L"), level.cast("string"), F.lit("_"), stamp, F.lit(".nsl"))


def gathered(compressed: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` (with image_id and device_ord) from a progressive codec's blocks."""
    block = F.struct(F.col("py").cast("int").alias("oy"), F.col("px").cast("int").alias("ox"), F.struct(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "y", "cb", "cr").alias("b"))
    return compressed.groupBy("image_id", "device_ord", "device_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "level").agg(F.transform(F.sort_array(F.collect_list(block)), lambda s: s["b"]).alias("blocks"))


def spread(files: DataFrame, image_id: Column, device_ord: Column) -> DataFrame:
    """A progressive codec's blocks from rows of ``SCHEMA``."""
    return files.select(image_id.alias("image_id"), device_ord.alias("device_ord"), "device_id", "level", "width", "height", F.explode("blocks").alias("b")).select("image_id", "device_ord", "device_id", "level", "width", "height", "b.px", "b.py", "b.y", "b.cb", "b.cr")


def to_bytes(copies: DataFrame, timestamp: int = 0) -> DataFrame:
    """Adds ``content``, the file's bytes; the blocks column goes."""
    keep = [f for f in copies.schema.fields if f.name not in ("blocks", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["device_id", "width", "height", "level", "blocks"]).to_pylist()
            data = pa.array([encode(timestamp=timestamp, **r) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], data], [*[f.name for f in keep], "content"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return copies.mapInArrow(run, StructType([*keep, StructField("content", BinaryType())]))


def from_bytes(files: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """Rows ``path`` and ``SCHEMA`` of files (path, content); broken files drop out unless ``strict``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("device_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("level", pa.int32()), ("blocks", pa.list_(pa.struct([("px", pa.int32()), ("py", pa.int32()), *[(c, pa.list_(pa.int32())) for c in ("y", "cb", "cr")]])))])
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append({"path": path} | decode(data))
                except (FormatError, UnicodeDecodeError):
                    if strict:
                        raise
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", F.col(content).alias("content")).mapInArrow(run, f"path string, {SCHEMA}")


def read_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return from_bytes(spark.read.format("binaryFile").option("pathGlobFilter", "*.nsl").load(path), strict=strict)


def same_size(files: DataFrame) -> DataFrame:
    """The files, or an error if there is none or their images differ in size."""
    found = files.agg(F.count_distinct("width", "height").alias("n")).first()["n"]
    if found != 1:
        raise ValueError("no valid file" if not found else "the files' images differ in size")
    return files


class CoefficientFiles(DataSource):
    """Data source ``nsl``: reads a folder's files, writes a file a row (columns of ``SCHEMA``).

    Read options: ``batchBytes``, the bytes of files that one task reads (64 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "nsl"

    def schema(self) -> str:
        return f"path string, {SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("batchbytes", self.options.get("batchBytes", 64 << 20))))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def _store(path: str):
    """The file system and the folder; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def partitions(self):
        from pyarrow import fs

        store, inside = _store(self.path)
        held, size, out = [], 0, []
        for f in sorted(store.get_file_info(fs.FileSelector(inside)), key=lambda f: f.path):
            if not f.path.endswith(".nsl"):
                continue
            if held and size + f.size > self.batch:
                out.append(_Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, _Files(held)]

    def read(self, partition):
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                row = decode(f.read())
            blocks = [(b["px"], b["py"], b["y"], b["cb"], b["cr"]) for b in row["blocks"]]
            yield (path, row["device_id"], row["width"], row["height"], row["level"], blocks)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Tasks write to a folder of the job; committing moves the files of the attempts that count, and only those."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, inside = _store(self.path)
        store.create_dir(f"{inside}/{self.staging}", recursive=True)
        part, attempt, names = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], []
        for i, r in enumerate(rows):
            names.append(f"{part:05d}-{i:05d}-{attempt}_L{r['level']}.nsl")
            with store.open_output_stream(f"{inside}/{self.staging}/{names[-1]}") as f:
                f.write(encode(r["device_id"], r["width"], r["height"], r["level"], [b.asDict() for b in r["blocks"]]))
        return _Written(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, inside = _store(self.path)
        store.create_dir(inside, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(inside)) if f.path.endswith(".nsl")] if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{inside}/{self.staging}/{name}", f"{inside}/{name}")
        for path in old:
            store.delete_file(path)
        self._clear(store, inside)

    def abort(self, messages) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, inside: str) -> None:
        if store.get_file_info(f"{inside}/{self.staging}").type.name == "Directory":
            store.delete_dir(f"{inside}/{self.staging}")
