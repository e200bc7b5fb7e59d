"""The four codecs as DataFrame pipelines, and the registry that names them.

A request relation says which image is compressed how::

    request (image_id, device_ord, device_id, quality)  or  (..., level)

``compress`` gives one row per block (cosine codecs), band value (wavelet) or run
(run-length), ``decompress`` gives pixels, ``reconstruct`` merges the copies of an
image by several devices, ``sizes`` gives the size model's bytes per copy.
Devices are numbered by ``device_ord``; where copies tie, the smaller number wins.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codec_math as m
from ..functions import strategy as st
from ..functions.rounding import round_half_up, store_byte, to_byte
from ..functions.tables import UNZIGZAG, int_array
from .blocks import CHANNELS, dct, haar, inverse_dct, inverse_haar, to_blocks, to_gray, to_pixels, unzigzag, zigzag

COPY = ["image_id", "device_ord", "device_id"]


class Codec(Protocol):
    def compress(self, pixels: DataFrame, requests: DataFrame) -> DataFrame: ...

    def decompress(self, compressed: DataFrame) -> DataFrame: ...

    def reconstruct(self, compressed: DataFrame) -> DataFrame: ...

    def sizes(self, compressed: DataFrame) -> DataFrame: ...


def _with_strategy(requests: DataFrame, **columns) -> DataFrame:
    """Adds device columns computed once per different device, joined back by identifier."""
    own = requests.select("device_id").distinct().select("device_id", *[f(F.col("device_id")).alias(n) for n, f in columns.items()])
    return requests.join(own, "device_id")


def _quantized(coefficients: Column, matrix: Column) -> Column:
    return F.zip_with(coefficients, matrix, m.quantize)


def _dequantized(line: Column, matrix: Column) -> Column:
    return F.zip_with(unzigzag(line), matrix, lambda c, q: (c * q).cast("double"))


def best_copy(copies: Column, names: tuple[str, ...]) -> Column:
    """Of copies (device_ord, q and arrays ``names``), at each of 64 positions q, device_ord and the values of the one with the smallest q."""
    at = lambda p: F.array_min(F.transform(copies, lambda c: F.struct(F.get(c["q"], p).alias("q"), c["device_ord"].alias("device_ord"), *[F.get(c[n], p).alias(n) for n in names])))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), at)


class ProgressiveDct:
    """Every device raises its own order of quantizers, level by level."""

    @staticmethod
    def _levels(requests: DataFrame) -> DataFrame:
        return requests if "level" in requests.columns else requests.withColumn("level", m.level_of_quality(F.col("quality")))

    def compress(self, pixels: DataFrame, requests: DataFrame) -> DataFrame:
        wanted = _with_strategy(self._levels(requests), order=st.quantization_order)
        wanted = wanted.select(*COPY, "level", st.quantizer_matrix(F.col("order"), F.col("level")).alias("q"))
        coded = dct(to_blocks(pixels)).join(wanted, "image_id")
        return coded.select(*COPY, "level", "width", "height", "px", "py", *[zigzag(_quantized(F.col(c), F.col("q"))).alias(c) for c in CHANNELS])

    @staticmethod
    def _matrices(compressed: DataFrame) -> DataFrame:
        own = compressed.select("device_id", "level").distinct()
        own = own.select("device_id", "level", st.quantizer_matrix(st.quantization_order(F.col("device_id")), F.col("level")).alias("q"))
        return compressed.join(own, ["device_id", "level"])

    def decompress(self, compressed: DataFrame) -> DataFrame:
        rows = self._matrices(compressed)
        rows = rows.select(*COPY, "width", "height", "px", "py", *[_dequantized(F.col(c), F.col("q")).alias(c) for c in CHANNELS])
        return to_pixels(inverse_dct(rows))

    def merged(self, compressed: DataFrame) -> DataFrame:
        """Blocks of the best copy of every coefficient: the smallest quantizer, then the smaller device number.

        The copies of a block, as many as there are devices, meet in one row.
        """
        first = compressed.groupBy("image_id").agg(F.min_by(F.struct("width", "height"), "device_ord").alias("s"))
        rows = self._matrices(compressed.dropDuplicates([*COPY, "px", "py"]))
        copy = F.struct("device_ord", "q", *[_dequantized(F.col(c), F.col("q")).alias(c) for c in CHANNELS])
        met = rows.groupBy("image_id", "px", "py").agg(F.collect_list(copy).alias("copies"))
        lines = met.select("image_id", "px", "py", best_copy(F.col("copies"), CHANNELS).alias("l"))
        line = lambda c: F.transform("l", lambda t: t[c]).alias(c)
        return lines.join(first, "image_id").select("image_id", "s.width", "s.height", "px", "py", *map(line, CHANNELS))

    def reconstruct(self, compressed: DataFrame) -> DataFrame:
        """Pixels of the merge; one inverse transform a block, whatever the number of devices."""
        return to_pixels(inverse_dct(self.merged(compressed)))

    def sizes(self, compressed: DataFrame) -> DataFrame:
        """21 bytes and the identifier, 10 a block, 3 a nonzero coefficient."""
        n = sum((m.nonzeros(F.col(c)) for c in CHANNELS), F.lit(0))
        return compressed.groupBy(*COPY, "level").agg((F.lit(21) + F.max(F.length("device_id")) + F.sum(10 + 3 * n)).cast("long").alias("size"))

    def recompress(self, compressed: DataFrame, level: int) -> DataFrame:
        """Decodes and encodes at a strictly higher level; an error where the level isn't higher."""
        guard = F.when(F.col("level") < level, F.lit(level)).otherwise(F.raise_error(F.lit("the new level must be higher than the current one")).cast("int"))
        wanted = compressed.select(*COPY, "level").distinct().withColumn("level", guard)
        pixels = self.decompress(compressed).withColumn("image_id", F.struct("image_id", "device_ord"))
        out = self.compress(pixels, wanted.withColumn("image_id", F.struct("image_id", "device_ord")))
        return out.withColumn("image_id", F.col("image_id.image_id"))


class MaskedDct:
    """Quality ladder of quantizers; at low quality each device keeps its own frequencies."""

    _STRATEGY = {"mask": st.frequency_mask, "matrix": st.luminance_matrix, "weights": st.channel_weights}

    @staticmethod
    def _ladder(quality: Column, matrix: Column) -> Column:
        return F.transform(matrix, lambda q, p: m.ladder_quantizer(quality, F.floor(p / 8), p % 8, q))

    def compress(self, pixels: DataFrame, requests: DataFrame) -> DataFrame:
        wanted = _with_strategy(requests, **self._STRATEGY).withColumn("q", self._ladder(F.col("quality"), F.col("matrix")))
        coded = dct(to_blocks(pixels)).join(wanted.select(*COPY, "quality", "mask", "weights", "q"), "image_id")

        def channel(c: str) -> Column:
            line = F.transform(zigzag(_quantized(F.col(c), F.col("q"))), lambda v, i: F.when(m.keeps(F.col("quality"), i, F.get("mask", i)), v).otherwise(0))
            skip = (F.col("quality") < 0.8) & (F.col(f"weights.{c}") < 0.001)
            line = F.when(~F.coalesce(skip, F.lit(False)), line)
            return F.when(F.exists(line, lambda v: v != 0), line).alias(c)

        return coded.select(*COPY, "quality", "width", "height", "px", "py", *[channel(c) for c in CHANNELS])

    def _matrices(self, compressed: DataFrame) -> DataFrame:
        own = compressed.select("device_id", "quality").distinct()
        own = own.select("device_id", "quality", self._ladder(F.col("quality"), st.luminance_matrix(F.col("device_id"))).alias("q"))
        return compressed.join(own, ["device_id", "quality"])

    def decompress(self, compressed: DataFrame) -> DataFrame:
        rows = self._matrices(compressed)
        return to_pixels(inverse_dct(rows.select(*COPY, "quality", "width", "height", "px", "py", *[_dequantized(F.col(c), F.col("q")).alias(c) for c in CHANNELS])))

    def reconstruct(self, compressed: DataFrame) -> DataFrame:
        """Mean of all copies' pixels if their qualities span 0.1 or less, else of those within 0.05 of the best."""
        ends = compressed.groupBy("image_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        near = compressed.join(ends, "image_id").filter("hi - lo <= 0.1 OR quality >= hi - 0.05").drop("lo", "hi")
        return self.decompress(near).groupBy("image_id", "x", "y").agg(*[round_half_up(F.avg(c)).cast("int").alias(c) for c in "rgb"])

    def reconstruct_frequencies(self, compressed: DataFrame) -> DataFrame:
        """Per coefficient, the nonzero value of the copy with the highest quality (then the smaller number),
        dequantized with the matrix of the best copy of the image."""
        best = compressed.groupBy("image_id").agg(F.max(F.struct("quality", (-F.col("device_ord")).alias("o"), "device_id", "width", "height")).alias("b"))
        best = self._matrices(best.select("image_id", "b.quality", "b.device_id", "b.width", "b.height")).drop("device_id", "quality")
        every = compressed.select("image_id", "px", "py", "quality", "device_ord", F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("line")) for c in CHANNELS])).alias("s"))
        values = every.select("image_id", "px", "py", "quality", "device_ord", "s.ch", F.posexplode("s.line").alias("p", "v")).filter("v <> 0")
        top = values.groupBy("image_id", "px", "py", "ch", "p").agg(F.max(F.struct("quality", (-F.col("device_ord")).alias("o"), "v")).alias("t"))
        lines = top.groupBy("image_id", "px", "py").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("ch") == c, F.struct("p", "t.v")))).alias(c) for c in CHANNELS])
        # Blocks without any nonzero value decode as grey.
        grid = compressed.select("image_id", "px", "py").distinct().join(lines, ["image_id", "px", "py"], "left").join(best, "image_id")
        full = lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at(c, i), F.lit(0)))
        return to_pixels(inverse_dct(grid.select("image_id", "width", "height", "px", "py", *[_dequantized(full(F.col(c)), F.col("q")).alias(c) for c in CHANNELS])))

    def reconstruct_masked_mean(self, compressed: DataFrame) -> DataFrame:
        """Per coefficient, the mean of the dequantized nonzero values that the copies' masks keep; 0 where none has one."""
        rows = self._matrices(compressed).withColumn("kept", st.frequency_mask(F.col("device_id")))
        value = lambda c: F.zip_with(unzigzag(F.col(c)), "q", lambda v, q: (v * q).cast("double"))
        shown = F.transform(int_array(UNZIGZAG), lambda z: F.get("kept", z))
        masked = lambda c: F.zip_with(value(c), shown, lambda v, k: F.when(k & (v != 0), v)).alias(c)
        met = rows.groupBy("image_id", "width", "height", "px", "py").agg(*[F.collect_list(masked(c)).alias(c) for c in CHANNELS])
        total = lambda c, p: F.aggregate(c, F.lit(0.0), lambda t, x: t + F.coalesce(F.get(x, p), F.lit(0.0)))
        many = lambda c, p: F.size(F.filter(c, lambda x: F.get(x, p).isNotNull()))
        mean = lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.when(many(F.col(c), p) > 0, total(F.col(c), p) / many(F.col(c), p)).otherwise(0.0)).alias(c)
        return to_pixels(inverse_dct(met.select("image_id", "width", "height", "px", "py", *map(mean, CHANNELS))))

    def sizes(self, compressed: DataFrame) -> DataFrame:
        """Fixed shares of the raw size at high quality, else 100 bytes and the coefficients' model."""
        raw = F.max("width") * F.max("height") * 3
        each = sum((F.coalesce(m.dct_block_bytes(F.col(c)), F.lit(0.0)) for c in CHANNELS), F.lit(0.0))
        q = F.col("quality")
        share = F.when(q >= 0.95, 0.9).when(q >= 0.85, 0.65).when(q >= 0.75, 0.4)
        out = compressed.groupBy(*COPY, "quality").agg(raw.alias("raw"), F.sum(each).alias("coded"))
        return out.select(*COPY, "quality", F.coalesce(round_half_up(F.col("raw") * share), 100 + F.col("coded")).alias("size"))


class Wavelet:
    """One Haar level of the gray image; detail bands thresholded by device and quantized by quality."""

    def compress(self, pixels: DataFrame, requests: DataFrame) -> DataFrame:
        sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
        sizes = sizes.withColumn("width", F.when((F.col("width") > 1) & (F.col("height") > 1), F.col("width")).otherwise(F.raise_error(F.lit("an image must have two rows and columns")).cast("long")))
        wanted = requests.join(sizes, "image_id").withColumn("threshold", st.wavelet_threshold(F.col("device_id")))
        v = F.when(F.col("band") == "LL", F.col("v")).otherwise(m.wavelet_quantize(F.col("v"), F.col("quality"), F.col("threshold")))
        return haar(to_gray(pixels), ["image_id"]).join(wanted, "image_id").select(*COPY, "quality", "width", "height", "band", "y", "x", v.alias("v"))

    @staticmethod
    def _pixels(gray: DataFrame, keys: list[str]) -> DataFrame:
        v = to_byte(F.col("v"))
        return gray.select(*keys, "x", "y", v.alias("r"), v.alias("g"), v.alias("b"))

    @staticmethod
    def _edges(pixels: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
        """Adds the black pixels of an odd last row or column."""
        row = sizes.filter("height % 2 = 1").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("x"), (F.col("height") - 1).alias("y"))
        col = sizes.filter("width % 2 = 1").select(*keys, (F.col("width") - 1).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y"))
        return pixels.unionByName(row.unionByName(col).distinct().select(*keys, "x", "y", *[F.lit(0).alias(c) for c in "rgb"]))

    def decompress(self, compressed: DataFrame) -> DataFrame:
        sizes = compressed.select(*COPY, "width", "height").distinct()
        return self._edges(self._pixels(inverse_haar(compressed, COPY), COPY), sizes, COPY)

    def reconstruct(self, compressed: DataFrame) -> DataFrame:
        mean = compressed.groupBy("image_id", "band", "y", "x").agg(F.avg("v").alias("v"))
        sizes = compressed.groupBy("image_id").agg(F.min_by(F.struct("width", "height"), "device_ord").alias("s")).select("image_id", "s.*")
        return self._edges(self._pixels(inverse_haar(mean, ["image_id"]), ["image_id"]), sizes, ["image_id"])

    def sizes(self, compressed: DataFrame) -> DataFrame:
        return compressed.groupBy(*COPY, "quality").agg((100 + 2 * F.count_if(F.col("v") != 0)).cast("double").alias("size"))


class RunLength:
    """Runs of equal quantized grays in raster order, broken at the device's phase below quality 0.9."""

    @staticmethod
    def runs(samples: DataFrame, keys: list[str], phase: Column | None = None) -> DataFrame:
        """Runs of rows keys, idx, v: keys, run_no, start, value, length.  ``phase``: forced breaks at idx % 16, null for none."""
        by = Window.partitionBy(*keys).orderBy("idx")
        cut = (F.lag("v").over(by) != F.col("v")) | F.coalesce((F.col("idx") > 0) & (F.col("idx") % 16 == (phase if phase is not None else F.lit(None).cast("int"))), F.lit(False))
        marked = samples.withColumn("__c", F.coalesce(cut, F.lit(False)).cast("int"))
        numbered = marked.withColumn("run_no", F.sum("__c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, "run_no").agg(F.min("idx").alias("start"), F.min_by("v", "idx").alias("value"), F.count("*").alias("length"))

    def compress(self, pixels: DataFrame, requests: DataFrame) -> DataFrame:
        sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
        wanted = requests.join(sizes, "image_id").withColumn("phase", F.when(F.col("quality") < 0.9, st.run_break_phase(F.col("device_id"))))
        grays = to_gray(pixels).join(wanted, "image_id")
        samples = grays.select(*COPY, "quality", "width", "height", "phase", (F.col("y") * F.col("width") + F.col("x")).alias("idx"), m.quantize_gray(F.col("v"), F.col("quality")).alias("v"))
        keys = [*COPY, "quality", "width", "height", "phase"]
        return self.runs(samples, keys, F.col("phase")).drop("phase")

    @staticmethod
    def expand(runs: DataFrame, keys: list[str]) -> DataFrame:
        """Rows keys, idx, value; what lies beyond width * height is cut."""
        by = Window.partitionBy(*keys).orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
        placed = runs.withColumn("__at", F.coalesce(F.sum("length").over(by), F.lit(0)))
        return placed.withColumn("idx", F.explode(F.sequence(F.col("__at"), F.col("__at") + F.col("length") - 1))).filter("idx < width * height").drop("__at")

    def decompress(self, compressed: DataFrame) -> DataFrame:
        v = store_byte(F.col("value"))
        rows = self.expand(compressed, COPY)
        return rows.select(*COPY, (F.col("idx") % F.col("width")).alias("x"), F.floor(F.col("idx") / F.col("width")).alias("y"), v.alias("r"), v.alias("g"), v.alias("b"))

    def reconstruct(self, compressed: DataFrame) -> DataFrame:
        v = round_half_up(F.avg("r")).cast("int")
        return self.decompress(compressed).groupBy("image_id", "x", "y").agg(v.alias("r"), v.alias("g"), v.alias("b"))

    def sizes(self, compressed: DataFrame) -> DataFrame:
        return compressed.groupBy(*COPY, "quality").agg((100 + 2 * F.count("*")).cast("double").alias("size"))


class CodecRegistry:
    """Codecs by name; a later registration of a name replaces the earlier one."""

    def __init__(self):
        self._codecs: dict[str, Codec] = {}

    def register(self, name: str, codec: Codec) -> None:
        self._codecs[name] = codec

    def get(self, name: str) -> Codec:
        if name not in self._codecs:
            raise KeyError(f"no codec {name!r}; there are: {', '.join(self._codecs)}")
        return self._codecs[name]

    def names(self) -> list[str]:
        return list(self._codecs)


class CodecManager:
    """The codecs and the one in use."""

    def __init__(self, current: str = "qdct"):
        self.registry = CodecRegistry()
        for name, codec in (("qdct", ProgressiveDct()), ("dct", MaskedDct()), ("wavelet", Wavelet()), ("rle", RunLength())):
            self.registry.register(name, codec)
        self.use(current)

    def use(self, name: str) -> Codec:
        self.codec, self.current = self.registry.get(name), name
        return self.codec

    def compress(self, pixels: DataFrame, requests: DataFrame) -> DataFrame:
        return self.codec.compress(pixels, requests)

    def decompress(self, compressed: DataFrame) -> DataFrame:
        return self.codec.decompress(compressed)

    def reconstruct(self, compressed: DataFrame) -> DataFrame:
        if compressed.isEmpty():
            raise ValueError("no compressed versions were given")
        return self.codec.reconstruct(compressed)

    def preview(self, compressed: DataFrame, most: int = 50_000) -> DataFrame:
        """Pixels of every copy; of a copy with more than ``most`` blocks one empty pixel."""
        blocks = compressed.groupBy(*COPY).agg(F.count("*").alias("__n"))
        large = blocks.filter(F.col("__n") > most)
        shown = self.codec.decompress(compressed.join(large.drop("__n"), COPY, "left_anti")).select(*COPY, "x", "y", *"rgb")
        return shown.unionByName(large.select(*COPY, *[F.lit(0).cast("long").alias(c) for c in "xy"], *[F.lit(0).alias(c) for c in "rgb"]))

    def strategy(self, devices: DataFrame) -> DataFrame | None:
        """The devices' strategies, or None where the codec has none."""
        if self.current == "qdct":
            return devices.withColumn("strategy", st.qdct_strategy(F.col("device_id")))
        return devices.withColumn("strategy", st.dct_strategy(F.col("device_id"))) if self.current == "dct" else None
