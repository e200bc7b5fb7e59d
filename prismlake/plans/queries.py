"""The registered queries over the driver's tables.

Embeddings (64 numbers each) serve as 8x8 blocks scaled by 255, supplier names as
device identifiers, events as one-dimensional signals.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec_math as m
from ..functions import rounding as rd
from ..functions import strategy as st
from ..operators import blocks as bl
from ..operators import codecs, metrics, sizing
from ..sources import coefficient_file, reports, synth
from ..streaming import cache as incremental

#: (number, identifier, level) of the copies that the merge queries make.
COPIES = ((0, "DEVICE-001", 6), (1, "DEVICE-002", 32), (2, "DEVICE-003", 50))
QUALITIES = (0.3, 0.5, 0.7)
# The levels of a sweep.
SWEEP = (0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 70, 80, 90, 100, 120, 150, 200)
#: The searches look at every level up to this one.
MOST = 1000
#: Qualities of the masked codec's copies: one for each step of its ladder, then those that are merged.
MASKED = ((0, "DEVICE-001", 0.96), (1, "DEVICE-002", 0.88), (2, "DEVICE-003", 0.78), (3, "DEVICE-001", 0.7), (4, "DEVICE-002", 0.66), (5, "DEVICE-003", 0.3))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_name").alias("device_id")).distinct()


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


# Strategies and matrices


def qdct_order(spark, d):
    return metrics.selection_order(suppliers(spark, d))


def qdct_matrix(spark, d):
    return metrics.matrices(suppliers(spark, d), [0, 1, 5, 10, 20, 50, 64, 100]).drop("row", "col")


def qdct_matrix_stats(spark, d):
    out = metrics.matrix_statistics(metrics.matrices(suppliers(spark, d), list(range(0, 201, 5))))
    return out.select("device_id", "level", r6("avg_quantization").alias("avg_quantization"), "min_quantization", "max_quantization", r6("std_deviation").alias("std_deviation"))


def theoretical_ratio(spark, d):
    out = metrics.theoretical_ratio(metrics.matrices(suppliers(spark, d), list(range(0, 151, 2))))
    return out.select("device_id", "level", r6("theoretical_ratio").alias("theoretical_ratio"), r6("avg_quantization").alias("avg_quantization"))


def device_comparison(spark, d):
    return metrics.leading_quantizers(metrics.matrices(suppliers(spark, d), [0, 10, 20, 30, 40, 50]))


def frequency_band_counts(spark, d):
    return qdct_order(spark, d).filter("order_index < 16").groupBy("device_id", "frequency_band").agg(F.count("*").alias("n"))


def dct_mask(spark, d):
    return suppliers(spark, d).select("device_id", F.posexplode(st.frequency_mask(F.col("device_id"))).alias("position", "kept"))


def dct_mask_coverage(spark, d):
    return metrics.mask_coverage(suppliers(spark, d))


def dct_quant_matrix(spark, d):
    return suppliers(spark, d).select("device_id", F.posexplode(st.luminance_matrix(F.col("device_id"))).alias("position", "q"))


def device_constants(spark, d):
    i = F.col("device_id")
    w = st.channel_weights(i)
    return suppliers(spark, d).select("device_id", st.digest(i).alias("digest"), *[r6(w[c]).alias(f"w_{c}") for c in bl.CHANNELS], st.spatial_pattern(i).alias("spatial_pattern"), r6(st.wavelet_threshold(i)).alias("threshold"), st.run_break_phase(i).alias("phase"))


def quality_ladder(spark, d):
    own = suppliers(spark, d).select("device_id", F.posexplode(st.luminance_matrix(F.col("device_id"))).alias("p", "q"))
    rows = own.withColumn("quality", F.explode(F.array(*[F.lit(q) for q in (0.1, 0.5, 0.8, 0.9, 1.0)])))
    return rows.select("device_id", "quality", F.col("p").alias("position"), m.ladder_quantizer(F.col("quality"), F.floor(F.col("p") / 8), F.col("p") % 8, F.col("q")).alias("quantizer"))


def matrix_heat(spark, d):
    mat = metrics.increase(metrics.matrices(suppliers(spark, d), [20, 40]))
    return mat.groupBy("device_id", "level", m.heat_class(F.col("value")).alias("heat")).agg(F.count("*").alias("n"), r6(F.avg("increase_percent")).alias("avg_increase"))


# Block transforms


def samples(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 255).alias("s"))


def coefficients(spark, d) -> DataFrame:
    """vec_id, label, s, c with coefficients rounded to 9 digits, which settles exact halves alike everywhere."""
    return bl.dct(samples(spark, d).withColumn("c", F.col("s")), ("c",)).withColumn("c", F.transform("c", lambda v: F.round(v, 9)))


def block_dct(spark, d):
    coded = bl.dct(samples(spark, d).select("vec_id", "s"), ("s",))
    return coded.select("vec_id", F.posexplode("s").alias("k", "c")).select("vec_id", "k", r6("c").alias("c"))


def block_idct_roundtrip(spark, d):
    back = bl.inverse_dct(coefficients(spark, d).withColumn("b", F.col("c")), ("b",))
    gap = F.array_max(F.zip_with("s", "b", lambda a, b: F.abs(a - b)))
    return back.select("vec_id", F.round(gap, 5).alias("gap"), r6(F.aggregate("c", F.lit(0.0), lambda t, v: t + v * v) / F.aggregate("s", F.lit(0.0), lambda t, v: t + v * v)).alias("energy"))


def _copies(spark, d, copies=COPIES) -> DataFrame:
    """Copies of every embedding's block: vec_id, label, s, device_ord, device_id, level, q, z (row by row)."""
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("device_ord"), F.lit(i).alias("device_id"), F.lit(v).alias("level")) for o, i, v in copies]))
    own = spark.range(1).select(each.alias("r")).select("r.*").withColumn("q", st.quantizer_matrix(st.quantization_order(F.col("device_id")), F.col("level")))
    rows = coefficients(spark, d).join(F.broadcast(own))  # len(copies) rows
    return rows.withColumn("z", F.zip_with("c", "q", m.quantize))


def zigzag_quantize(spark, d):
    return _copies(spark, d).select("vec_id", "device_id", F.posexplode(bl.zigzag(F.col("z"))).alias("zig", "value")).filter("value <> 0")


def dequantize(spark, d):
    return _copies(spark, d).select("vec_id", "device_id", F.posexplode(F.zip_with("z", "q", lambda z, q: z * q)).alias("pos", "value")).filter("value <> 0")


def qdct_compress_size(spark, d):
    n = m.nonzeros(F.col("z"))
    return _copies(spark, d).select("vec_id", "device_id", (21 + F.length("device_id") + 10 + 3 * n).alias("size"), (metrics.file_bytes(F.col("device_id"), 10 + 3 * n)).alias("file_size"))


def dct_size(spark, d):
    own = spark.range(1).select(F.lit("DEVICE-001").alias("device_id"), F.explode(F.array(*[F.lit(q) for q in QUALITIES])).alias("quality"))
    own = own.withColumn("matrix", st.luminance_matrix(F.col("device_id"))).withColumn("mask", st.frequency_mask(F.col("device_id")))
    own = own.withColumn("q", codecs.MaskedDct._ladder(F.col("quality"), F.col("matrix")))
    rows = coefficients(spark, d).join(F.broadcast(own))  # len(QUALITIES) rows
    line = F.transform(bl.zigzag(F.zip_with("c", "q", m.quantize)), lambda v, i: F.when(m.keeps(F.col("quality"), i, F.get("mask", i)), v).otherwise(0))
    return rows.select("vec_id", "quality", r6(100 + m.dct_block_bytes(line)).alias("size"))


def _merged(spark, d) -> DataFrame:
    """vec_id, label, s and the best copy of each position (q, device_ord, z); a vector's copies meet in one row."""
    copies = F.collect_list(F.struct("device_ord", "q", "z"))
    met = _copies(spark, d).groupBy("vec_id").agg(F.first("label").alias("label"), F.first("s").alias("s"), copies.alias("copies"))
    return met.select("vec_id", "label", "s", codecs.best_copy(F.col("copies"), ("z",)).alias("best"))


def qdct_reconstruct(spark, d):
    best = _merged(spark, d).select("vec_id", F.posexplode("best").alias("pos", "b"))
    return best.select("vec_id", "pos", "b.device_ord", (F.col("b.q") * F.col("b.z")).cast("long").alias("value"))


def psnr_by_label(spark, d):
    value = F.transform("best", lambda t: (t["q"] * t["z"]).cast("double")).alias("c")
    merged = _merged(spark, d).select("label", "s", value, F.lit("merged").alias("copy"))
    single = _copies(spark, d).select("label", "s", F.zip_with("z", "q", lambda z, q: (z * q).cast("double")).alias("c"), F.col("device_id").alias("copy"))
    decoded = bl.inverse_dct(single.unionByName(merged), ("c",), ("b",))
    error = F.aggregate(F.zip_with("s", "b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    rows = decoded.groupBy("label", "copy").agg((F.sum(error) / (64 * F.count("*"))).alias("mse"))
    return rows.select("label", "copy", F.round("mse", 5).alias("mse"), F.round(m.psnr(F.col("mse")), 4).alias("psnr"))


def dct_freq_reconstruct(spark, d):
    """Highest quality with a nonzero value wins, then the smaller number; numbers as levels give the qualities."""
    rows = _copies(spark, d).select("vec_id", "device_ord", m.quality_of_level(F.col("level")).alias("quality"), F.posexplode("z").alias("pos", "z")).filter("z <> 0")
    top = rows.groupBy("vec_id", "pos").agg(F.max(F.struct("quality", (-F.col("device_ord")).alias("o"), "z")).alias("t"))
    return top.select("vec_id", "pos", (-F.col("t.o")).alias("device_ord"), F.col("t.z").alias("value"))


# Haar


def _grid(spark, d) -> DataFrame:
    return samples(spark, d).select("vec_id", F.posexplode("s").alias("p", "v")).select("vec_id", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).cast("long").alias("x"), "v")


def haar_forward(spark, d):
    return bl.haar(_grid(spark, d), ["vec_id"]).withColumn("v", r6("v"))


def _haar_copies(spark, d) -> DataFrame:
    rows = bl.haar(_grid(spark, d), ["vec_id"]).withColumn("device_id", F.explode(F.array(*[F.lit(i) for _, i, _ in COPIES])))
    q = m.wavelet_quantize(F.round("v", 9), F.lit(0.5), st.wavelet_threshold(F.col("device_id")))
    return rows.withColumn("v", F.when(F.col("band") == "LL", F.col("v")).otherwise(q))


def haar_quantize(spark, d):
    return _haar_copies(spark, d).filter("v <> 0").withColumn("v", r6("v"))


def haar_sizes(spark, d):
    return _haar_copies(spark, d).groupBy("vec_id", "device_id").agg((100 + 2 * F.count_if(F.col("v") != 0)).alias("size"))


def haar_reconstruct(spark, d):
    mean = _haar_copies(spark, d).groupBy("vec_id", "band", "y", "x").agg(F.avg("v").alias("v"))
    return bl.inverse_haar(mean, ["vec_id"]).select("vec_id", "y", "x", F.round("v", 5).alias("v"))


# Runs


def _signal(spark, d) -> DataFrame:
    """A signal per user: quantized event values in event order, numbered from 0."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.coalesce("value", F.lit(0.0)) / 16).cast("long").alias("v"))
    return e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("idx"), "v")


def rle_runs(spark, d):
    return codecs.RunLength.runs(_signal(spark, d), ["user_id"], F.lit(5))


def rle_expand(spark, d):
    runs = rle_runs(spark, d).withColumns({"width": F.lit(1 << 30), "height": F.lit(1)})
    return codecs.RunLength.expand(runs, ["user_id"]).select("user_id", "idx", F.col("value").alias("v"))


def rle_reconstruct(spark, d):
    """Mean over two copies with different break phases, which equals either."""
    width = {"width": F.lit(1 << 30), "height": F.lit(1)}
    copy = lambda k: codecs.RunLength.expand(codecs.RunLength.runs(_signal(spark, d), ["user_id"], F.lit(k)).withColumns(width), ["user_id"])
    return copy(3).unionByName(copy(9)).groupBy("user_id", "idx").agg(rd.round_half_up(F.avg("value")).cast("long").alias("v"))


def rle_sizes(spark, d):
    return rle_runs(spark, d).groupBy("user_id").agg((100 + 2 * F.count("*")).alias("size"))


# Colour and pictures


def rgb_ycbcr(spark, d):
    px = synth.image(spark, "rgb_gradient", 64, 64)
    y, cb, cr = m.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    r, g, b = m.rgb(y, cb, cr)
    return px.select("x", "y", r6(y).alias("luma"), r6(cb).alias("cb"), r6(cr).alias("cr"), r.alias("r2"), g.alias("g2"), b.alias("b2"))


def difference_image(spark, d):
    a, b = synth.image(spark, "gradient", 32, 32, "i"), synth.image(spark, "checkerboard", 32, 32, "i")
    return metrics.difference_image(a, b).drop("image_id")


def synthetic_images(spark, d):
    every = [synth.image(spark, p, 64, 48) for p in ("solid", "gradient", "checkerboard", "rgb_gradient", "checker_gradient", "scene_gradient", "scene_checkerboard", "colorbars")]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out.groupBy("image_id").agg(*[F.sum(c).alias(f"sum_{c}") for c in "rgb"], F.sum(F.col("r") * (F.col("x") + 1) + F.col("g") * (F.col("y") + 1)).alias("moment"))


def median_merge(spark, d):
    each = [synth.image(spark, p, 32, 32, "i") for p in ("gradient", "checkerboard", "solid")]
    return metrics.median_pixels(each[0].unionByName(each[1]).unionByName(each[2])).drop("image_id")


def image_psnr(spark, d):
    out = metrics.psnr(synth.image(spark, "gradient", 32, 32, "i"), synth.image(spark, "solid", 32, 32, "i"))
    return out.select(r6("mse").alias("mse"), r6("psnr").alias("psnr"))


# Sweeps and searches


def _sweep(spark, d) -> DataFrame:
    """Sizes of each label's blocks as one image, by level: label, level, size, ratio, blocks."""
    rows = _copies(spark, d, tuple((k, "DEVICE-001", v) for k, v in enumerate(SWEEP)))
    out = rows.groupBy("label", "level").agg((31 + F.sum(10 + 3 * m.nonzeros(F.col("z")))).alias("size"), F.count("*").alias("blocks"))
    return out.withColumn("ratio", F.col("blocks") * 64 * 3 / F.col("size"))


def level_sweep(spark, d):
    return _sweep(spark, d).select("label", "level", "size", r6("ratio").alias("ratio"))


def ratio_by_level(spark, d):
    return metrics.ratio_by_level(_sweep(spark, d)).withColumn("avg_ratio", r6("avg_ratio"))


def min_size_max_ratio(spark, d):
    return metrics.extremes(_sweep(spark, d), "label").withColumn("max_ratio", r6("max_ratio"))


def rate_table(spark, d):
    """Kilobytes, ratio and bits a pixel; a label's blocks lie side by side."""
    rate = metrics.rate(F.col("size"), F.col("blocks") * 8, F.lit(8))
    return _sweep(spark, d).select("label", "level", *[r6(c).alias(n) for n, c in rate.items()])


def _all_levels(spark, d) -> DataFrame:
    return sizing.all_levels(coefficients(spark, d).select("label", "c"), "DEVICE-001", st.quantization_order(F.lit("DEVICE-001")), MOST, "label")


def all_level_sizes(spark, d):
    return _all_levels(spark, d).select("label", "level", "size")


def size_target_setbased(spark, d):
    return sizing.smallest_level(_all_levels(spark, d), 5500, "label")


def memory_limit_setbased(spark, d):
    return sizing.largest_quality(_all_levels(spark, d).withColumn("quality", r6(m.quality_of_level(F.col("level")))), 6000, "label")


def level_search(spark, d):
    """Level by level search of the smallest level within shares of the size at level 0, for all blocks as one image."""
    every = coefficients(spark, d).select("c").persist()

    @cache
    def size_at(level: int) -> int:
        q = st.quantizer_matrix(st.quantization_order(F.lit("DEVICE-001")), F.lit(level))
        n = m.nonzeros(F.zip_with("c", "q", m.quantize))
        return every.join(F.broadcast(spark.range(1).select(q.alias("q")))).agg((31 + F.sum(10 + 3 * n)).alias("size")).first()["size"]

    whole = size_at(0)
    rows = [(t, *sizing.search_level(size_at, whole, t, MOST)) for t in (whole * f // 10 for f in (9, 7, 5))]
    every.unpersist()
    return spark.createDataFrame(rows, "target long, level int, size long")


def level_estimate(spark, d):
    ratio = F.col("p_retailprice") / 25.0
    return table(spark, d, "part").select("p_partkey", r6(m.level_of_ratio(ratio)).alias("level"), m.level_of_quality(F.least(F.lit(1.0), ratio / 100)).alias("quality_level"), rd.size_text(F.floor(F.col("p_retailprice") * 3000)).alias("size_text"))


# Whole codecs over pictures of the embeddings


def pictures(spark, d) -> DataFrame:
    """Pixels of pictures of four vectors each, one below the other; the channels read a vector in three orders."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    byte = lambda i: rd.to_byte(F.get("embedding", i).cast("double") * 255 + 128)
    pixel = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.struct(p.alias("p"), byte(p).alias("r"), byte(63 - p).alias("g"), byte((p * 5 + 3) % 64).alias("b")))
    at = e.select((F.col("vec_id") - F.pmod("vec_id", F.lit(4))).alias("image_id"), F.pmod("vec_id", F.lit(4)).alias("k"), F.explode(pixel).alias("t"))
    return at.select("image_id", (F.col("t.p") % 8).cast("long").alias("x"), (F.floor(F.col("t.p") / 8) + 8 * F.col("k")).cast("long").alias("y"), "t.r", "t.g", "t.b")


def _asked(px: DataFrame, copies, column: str) -> DataFrame:
    """Every picture asked for from every device."""
    kind = "int" if column == "level" else "double"
    each = px.sparkSession.createDataFrame(list(copies), f"device_ord int, device_id string, {column} {kind}")
    return px.select("image_id").distinct().join(F.broadcast(each))  # as many rows as copies


def _judged(px: DataFrame, codec: codecs.Codec, coded: DataFrame, merges: dict[str, DataFrame]) -> DataFrame:
    """image_id, copy, size and mse of every copy, and of every merge (whose size is not known)."""
    own = metrics.psnr(px, codec.decompress(coded), ["device_ord"]).join(codec.sizes(coded), ["image_id", "device_ord"])
    out = own.select("image_id", F.col("device_ord").cast("string").alias("copy"), F.col("size").cast("double").alias("size"), r6("mse").alias("mse"))
    for name, merged in merges.items():
        out = out.unionByName(metrics.psnr(px, merged).select("image_id", F.lit(name).alias("copy"), F.lit(None).cast("double").alias("size"), r6("mse").alias("mse")))
    return out


def codec_progressive(spark, d):
    px, codec = pictures(spark, d), codecs.CodecManager("qdct").codec
    coded = codec.compress(px, _asked(px, [(0, "DEVICE-001", 0.9), (1, "DEVICE-002", 0.5), (2, "DEVICE-003", 0.2)], "quality")).persist()  # decoded, sized and merged
    return _judged(px, codec, coded, {"merged": codec.reconstruct(coded)})


def codec_masked(spark, d):
    px, codec = pictures(spark, d), codecs.CodecManager("dct").codec
    coded = codec.compress(px, _asked(px, MASKED, "quality")).persist()  # decoded, sized and merged
    late = coded.filter("device_ord >= 3")
    return _judged(px, codec, coded, {"merged": codec.reconstruct(late), "frequencies": codec.reconstruct_frequencies(late), "masked mean": codec.reconstruct_masked_mean(late)})


def codec_wavelet(spark, d):
    px, codec = pictures(spark, d), codecs.CodecManager("wavelet").codec
    coded = codec.compress(px, _asked(px, [(k, i, 0.5) for k, i, _ in COPIES], "quality")).persist()  # decoded, sized and merged
    return _judged(px, codec, coded, {"merged": codec.reconstruct(coded)})


def codec_runs(spark, d):
    px, codec = pictures(spark, d), codecs.CodecManager("rle").codec
    coded = codec.compress(px, _asked(px, [(k, i, q) for (k, i, _), q in zip(COPIES, (0.95, 0.05, 0.02), strict=True)], "quality")).persist()  # decoded, sized and merged
    return _judged(px, codec, coded, {"merged": codec.reconstruct(coded)})


def nsl_roundtrip(spark, d):
    """Copies written as coefficient files and read back: bytes, nonzeros and a weighted sum of the coefficients."""
    px = pictures(spark, d)
    coded = codecs.ProgressiveDct().compress(px, _asked(px, COPIES, "level"))
    files = coefficient_file.to_bytes(coefficient_file.gathered(coded))
    named = files.select(F.concat_ws("/", "image_id", "device_ord").alias("path"), "content")
    back = coefficient_file.from_bytes(named, strict=True).join(named.select("path", F.length("content").cast("long").alias("n_bytes")), "path")

    def n(b: Column) -> Column:
        return m.nonzeros(b["y"]) + m.nonzeros(b["cb"]) + m.nonzeros(b["cr"])

    def mark(b: Column) -> Column:
        weighed = lambda c: F.aggregate(F.transform(c, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda t, v: t + v)
        return weighed(b["y"]) + 2 * weighed(b["cb"]) + 3 * weighed(b["cr"])

    total = lambda f: F.aggregate("blocks", F.lit(0).cast("long"), lambda t, b: t + f(b))
    return back.select("path", "device_id", "width", "height", "level", "n_bytes", total(n).cast("int").alias("nonzeros"), total(mark).alias("mark"))


def stored_size_total(spark, d):
    """Bytes of all coefficient files of all devices."""
    out = _copies(spark, d).groupBy("device_id").agg((36 + F.octet_length(F.first("device_id")) + F.sum(10 + 3 * m.nonzeros(F.col("z")))).alias("size"))
    return out.agg(F.count("*").alias("files"), F.sum("size").alias("size"))


# More statistics of strategies


def mask_coverage_summary(spark, d):
    return metrics.mask_coverage_summary(suppliers(spark, d)).withColumn("average", r6("average"))


def increment_statistics(spark, d):
    return metrics.increment_statistics(spark)


def matrix_walk_through(spark, d):
    out = metrics.walk_through(suppliers(spark, d))
    return out.select("device_id", *[r6(c).alias(c) for c in ("avg_increment", "avg_first", "avg_later")])


def extreme_levels(spark, d):
    """Statistics of matrices far along, up to where every quantizer has its limit."""
    out = metrics.matrix_statistics(metrics.matrices(suppliers(spark, d), [500, 1000, 5000, 16256, 20000]))
    return out.select("device_id", "level", r6("avg_quantization").alias("avg_quantization"), "min_quantization", "max_quantization")


def matrix_print(spark, d):
    mat = metrics.matrices(suppliers(spark, d), [5, 20, 64])
    return mat.groupBy("device_id", "level", m.print_class(F.col("value")).alias("class")).agg(F.count("*").alias("n"))


def leading_rows(spark, d):
    return metrics.leading_rows(metrics.matrices(suppliers(spark, d), [20, 40])).select("device_id", "level", "order_index", "pos", "value")


def matrix_grid(spark, d):
    mat = metrics.matrices(spark.range(1).select(F.lit("DEVICE-001").alias("device_id")), [40])
    return reports.pivot_grid(mat).select("row", *[F.col(str(c)).alias(f"c{c}") for c in range(8)])


def device_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", st.device_name(F.col("s_suppkey")).alias("device_name"))


# Beyond SQL: state, sampling


def incremental_cache(spark, d):
    blocks = samples(spark, d).select((F.col("vec_id") % 10).cast("string").alias("device_id"), F.col("vec_id").alias("seq"), F.lit(0.9) - (F.col("vec_id") % 7) / 10, F.col("s").alias("samples"))
    return incremental.fold(blocks.toDF("device_id", "seq", "quality", "samples"))


def sampled_size(spark, d):
    """Sizes of each label's blocks as one image, from 20 sampled blocks each."""
    rows = _copies(spark, d).select(F.col("label").alias("image_id"), "device_ord", "device_id", "level", F.col("vec_id").alias("px"), F.lit(0).alias("py"), F.col("z").alias("y"), *[F.lit(None).cast("array<int>").alias(c) for c in ("cb", "cr")])
    return sizing.sampled_size(rows, 20, 1)


NAMES = (
    "qdct_order qdct_matrix qdct_matrix_stats theoretical_ratio device_comparison frequency_band_counts dct_mask dct_mask_coverage "
    "dct_quant_matrix device_constants quality_ladder matrix_heat block_dct block_idct_roundtrip zigzag_quantize dequantize qdct_compress_size dct_size "
    "qdct_reconstruct psnr_by_label dct_freq_reconstruct haar_forward haar_quantize haar_sizes haar_reconstruct rle_runs rle_expand "
    "rle_reconstruct rle_sizes rgb_ycbcr difference_image synthetic_images median_merge image_psnr level_sweep ratio_by_level min_size_max_ratio "
    "all_level_sizes size_target_setbased memory_limit_setbased level_search level_estimate rate_table codec_progressive codec_masked codec_wavelet codec_runs "
    "nsl_roundtrip stored_size_total mask_coverage_summary increment_statistics matrix_walk_through extreme_levels matrix_print leading_rows matrix_grid "
    "device_names incremental_cache sampled_size"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
