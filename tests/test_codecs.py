"""Codec pipelines: invariants, expected sizes and qualities, merges, files, searches, state."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import rounding
from prismlake.functions.tables import INCREMENTS, UNZIGZAG, ZIGZAG, basis
from prismlake.operators import blocks, codecs, metrics, sizing
from prismlake.sources import coefficient_file as cf
from prismlake.sources import images, reports, synth
from prismlake.streaming import cache


def requests(spark, image, devices, **column):
    ((name, values),) = column.items()
    values = values if isinstance(values, list) else [values] * len(devices)
    kind = "int" if name == "level" else "double"
    return spark.createDataFrame([(image, k, d, v) for k, (d, v) in enumerate(zip(devices, values, strict=True))], f"image_id string, device_ord int, device_id string, {name} {kind}")


def quality_of(px, decoded, keys=()):
    return {tuple(r[k] for k in keys): r["psnr"] for r in metrics.psnr(px, decoded, list(keys)).collect()}


DEVICES = ["DEVICE-001", "DEVICE-002", "DEVICE-003"]


@pytest.mark.parametrize(
    ("image", "quality", "sizes", "single", "merged"),
    [
        ("rgb_gradient", 0.8, [4175, 4571, 4007], [57.52, 58.96, 57.26], 66.10),
        ("rgb_gradient", 0.2, [3695, 3551, 3167], [51.57, 51.03, 50.82], 51.90),
        ("checker_gradient", 0.6, [2507, 2417, 2603], [55.07, 54.95, 60.36], 69.34),
    ],
)
def test_progressive(spark, image, quality, sizes, single, merged):
    px = synth.image(spark, image, 64, 64).cache()
    codec = codecs.ProgressiveDct()
    coded = codec.compress(px, requests(spark, image, DEVICES, quality=quality)).cache()
    assert [r["size"] for r in codec.sizes(coded).orderBy("device_ord").collect()] == sizes
    got = quality_of(px, codec.decompress(coded), ["device_ord"])
    assert [round(got[k,], 2) for k in range(3)] == pytest.approx(single, abs=0.011)
    assert quality_of(px, codec.reconstruct(coded))[()] == pytest.approx(merged, abs=0.011)


def test_masked(spark):
    px = synth.image(spark, "rgb_gradient", 64, 64).cache()
    codec = codecs.MaskedDct()
    steps = [1.0, 0.9, 0.8, 0.7, 0.5, 0.3]
    coded = codec.compress(px, requests(spark, "rgb_gradient", ["DEVICE-001"] * 6, quality=steps)).cache()
    got = {r["device_ord"]: r["size"] for r in codec.sizes(coded).collect()}
    assert [got[k] for k in range(6)] == [11059, 7987, 4915, 1423.375, 1273.25, 1132.625]
    psnr = quality_of(px, codec.decompress(coded), ["device_ord"])
    assert [psnr[k,] for k in range(6)] == pytest.approx([46.59, 42.43, 41.49, 40.07, 36.33, 32.78], abs=0.011)
    best = quality_of(px, codec.reconstruct(coded))[()]
    assert best > 40 and quality_of(px, codec.reconstruct_frequencies(coded))[()] > 25


def test_wavelet_and_runs(spark):
    px = synth.image(spark, "rgb_gradient", 64, 64).cache()
    for codec, sizes in ((codecs.Wavelet(), [2148, 2148]), (codecs.RunLength(), [8284, 5274])):
        coded = codec.compress(px, requests(spark, "rgb_gradient", ["DEVICE-001"] * 2, quality=[1.0, 0.5]))
        assert [r["size"] for r in codec.sizes(coded).orderBy("device_ord").collect()] == sizes
        assert quality_of(px, codec.decompress(coded), ["device_ord"])[0,] == pytest.approx(13.73, abs=0.01)
    gray = synth.image(spark, "gradient", 17, 23).cache()
    coded = codecs.RunLength().compress(gray, requests(spark, "gradient", DEVICES, quality=0.5))
    back = codecs.RunLength().decompress(coded)
    assert back.groupBy("device_ord").agg(F.sum("r").alias("s")).select("s").distinct().count() == 1
    whole = codecs.Wavelet().compress(gray, requests(spark, "gradient", DEVICES, quality=1.0))
    out = codecs.Wavelet().reconstruct(whole)
    assert out.count() == 17 * 23 and out.filter("x = 16 OR y = 22").agg(F.max("r")).first()[0] == 0


def test_blocks(spark):
    px = synth.image(spark, "gradient", 17, 23)
    cut = blocks.to_blocks(px)
    assert cut.count() == blocks.block_count(17, 23) == 9
    back = blocks.to_pixels(blocks.inverse_dct(blocks.dct(cut)))
    assert metrics.psnr(px, back).first()["psnr"] == math.inf
    flat = spark.createDataFrame([([128.0] * 64,)], "v array<double>")
    c = blocks.dct(flat, ("v",)).first()["v"]
    assert c[0] > 1000 and max(map(abs, c[1:])) < 1e-3
    assert np.allclose(basis() @ basis().T, np.eye(64)) and [ZIGZAG[k] for k in UNZIGZAG] == list(range(64))
    assert ZIGZAG[:6] == [0, 1, 8, 16, 9, 2]
    rows = spark.range(64).select(F.lit(1).alias("b"), F.col("id").cast("int").alias("pos"), (F.col("id") * 3.0 % 17).alias("v"))
    joined = {r["k"]: r["c"] for r in blocks.dct_by_join(rows, ["b"]).collect()}
    kernel = basis() @ np.array([k * 3 % 17 for k in range(64)], float)
    assert np.allclose([joined[k] for k in range(64)], kernel)


def test_metrics_errors_and_ties(spark):
    a, b = synth.image(spark, "solid", 8, 8, "i"), synth.image(spark, "solid", 8, 9, "i")
    with pytest.raises(Exception, match="differ in size"):
        metrics.psnr(a, b).collect()
    with pytest.raises(KeyError, match="qdct"):
        codecs.CodecManager().use("none")
    with pytest.raises(ValueError):
        codecs.CodecManager().reconstruct(spark.createDataFrame([], "image_id string"))
    mat = metrics.matrices(spark.createDataFrame([("DEVICE-001",), ("DEVICE-002",)], "device_id string"), [1, 40]).cache()
    one = mat.filter("level = 1 AND device_id = 'DEVICE-001'")
    assert one.filter("value > 1").count() == 1
    r = metrics.matrix_difference(mat.filter("level = 40 AND device_id = 'DEVICE-001'"), mat.filter("level = 40 AND device_id = 'DEVICE-002'")).first()
    assert r["larger"] + r["smaller"] + r["equal"] == 64 and r["different"] > 0


def test_recompress(spark):
    px = synth.image(spark, "rgb_gradient", 64, 64)
    codec = codecs.ProgressiveDct()
    first = codec.compress(px, requests(spark, "rgb_gradient", ["DEVICE-009"], quality=0.9)).cache()
    again = codec.recompress(first, 32)
    decoded = codec.decompress(first).select("image_id", "x", "y", "r", "g", "b")
    direct = codec.compress(decoded, requests(spark, "rgb_gradient", ["DEVICE-009"], level=32))
    assert again.select("px", "py", "y", "cb", "cr").exceptAll(direct.select("px", "py", "y", "cb", "cr")).count() == 0
    assert codec.sizes(again).first()["size"] < codec.sizes(first).first()["size"]
    with pytest.raises(Exception, match="must be higher"):
        codec.recompress(first, 6).collect()


def _line(**at):
    return [at.get(f"p{i}", 0) for i in range(64)]


def test_coefficient_files(spark, tmp_path):
    blocks_ = [{"px": 16, "py": 24, "y": _line(p2=311, p9=-77, p62=5), "cb": _line(p40=-32768), "cr": _line(p1=32767, p3=-1)}, {"px": 0, "py": 65528, "y": None, "cb": _line(), "cr": _line(p20=6)}]
    data = cf.encode("lens-7", 48, 32, 17, blocks_)
    assert len(data) == 36 + 6 + 10 * 2 + 3 * 7
    back = cf.decode(data)
    assert back["blocks"][0] == blocks_[0] and back["blocks"][1]["y"] == _line() and (back["width"], back["height"], back["level"]) == (48, 32, 17)
    assert [cf.decode(cf.encode("é", 8, 8, level, []))["level"] for level in (0, 3, 4096)] == [0, 3, 4096]
    for broken, why in ((data[:31], "too small"), (b"none" + data[4:], "magic"), (data[:4] + b"\0\0\0\7" + data[8:], "version"), (cf.encode("", 8, 8, 0, []), "identifier"), (data[:-1], "ends within")):
        with pytest.raises(cf.FormatError, match=why):
            cf.decode(broken)
    (tmp_path / "a.nsl").write_bytes(data)
    (tmp_path / "b.nsl").write_bytes(data[:20])
    rows = cf.read_files(spark, str(tmp_path))
    assert rows.count() == 1 and cf.same_size(rows).first()["device_id"] == "lens-7"


def test_coefficient_file_source(spark, tmp_path):
    """Written files replace or join what is there; a failed job leaves nothing; reading packs files into tasks."""
    spark.dataSource.register(cf.CoefficientFiles)
    blocks_ = [{"px": 8, "py": 0, "y": _line(p4=9), "cb": _line(), "cr": _line()}]
    rows = spark.createDataFrame([(f"lens-{k}", 16, 8, k, blocks_) for k in range(12)], cf.SCHEMA).repartition(3)
    out = str(tmp_path / "out")
    rows.write.format("nsl").mode("append").save(out)
    rows.limit(5).write.format("nsl").mode("append").save(out)
    back = spark.read.format("nsl").load(out)
    assert back.count() == 17 and back.rdd.getNumPartitions() == 1
    assert spark.read.format("nsl").option("batchBytes", 200).load(out).rdd.getNumPartitions() > 5
    rows.limit(4).write.format("nsl").mode("overwrite").save(out)
    assert [r["blocks"][0]["y"][4] for r in spark.read.format("nsl").load(out).collect()] == [9] * 4
    bad = rows.withColumn("width", F.when(F.col("level") == 11, F.raise_error(F.lit("no width")).cast("int")).otherwise(F.col("width")))
    with pytest.raises(Exception, match="no width"):
        bad.write.format("nsl").mode("append").save(out)
    assert spark.read.format("nsl").load(out).count() == 4 and not [p for p in (tmp_path / "out").iterdir() if p.suffix != ".nsl"]


def test_file_names_are_in_utc(spark):
    at = spark.sql("SELECT timestamp_seconds(1710054000) AS t")  # 2024-03-10 07:00:00 UTC, when New York's clocks skip an hour
    zone = spark.conf.get("spark.sql.session.timeZone")
    for own in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", own)
        assert at.select(cf.file_name(F.lit("D"), F.lit(3), F.col("t")).alias("n")).first()["n"] == "D_L3_2024-03-10T07-00-00.nsl"
    spark.conf.set("spark.sql.session.timeZone", zone)


def _png(pixels):
    """A PNG file of an array (height, width, 1, 3 or 4)."""
    high, wide, channels = pixels.shape
    raw = b"".join(b"\0" + line.tobytes() for line in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", wide, high, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = {f"{c}.png": rng.integers(0, 256, (7, 11, n), dtype=np.uint8) for c, n in (("a", 3), ("b", 1), ("c", 4), ("d", 3))}
    for name, px in made.items():
        (tmp_path / name).write_bytes(_png(px))
    (tmp_path / "x.png").write_bytes(b"no image")
    rows = images.read_images(spark, str(tmp_path)).collect()
    for name, px in made.items():
        mine = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in rows if r["image_id"] == name}
        assert mine == {(x, y): tuple(int(v) for v in (px[y, x, :3] if px.shape[2] > 1 else px[y, x].repeat(3))) for y in range(7) for x in range(11)}
    assert {r["image_id"] for r in images.read_images(spark, str(tmp_path), most=2).collect()} == {"a.png", "b.png"}
    assert {r["image_id"] for r in images.read_images(spark, str(tmp_path), pattern="^[bd]").collect()} == {"b.png", "d.png"}
    assert images.read_images(spark, str(tmp_path), pattern="^z", most=3).count() == 0
    small = images.read_images(spark, str(tmp_path), longest=5)
    size = small.groupBy("image_id").agg(F.max("x").alias("x"), F.max("y").alias("y")).collect()
    assert {(r["x"] + 1, r["y"] + 1) for r in size} == {(5, 3)}  # 11 and 7 by 5 / 11, rounded down


def test_shrink():
    px = np.arange(24, dtype=np.uint8).reshape(4, 6, 1)
    assert images.shrink(px, 6) is px
    half = images.shrink(px, 3)
    assert half.shape == (2, 3, 1) and half[:, :, 0].tolist() == [[4, 6, 8], [16, 18, 20]]
    flat = np.full((301, 517, 3), 93, np.uint8)
    assert set(images.shrink(flat, 200).ravel().tolist()) == {93} and images.shrink(flat, 200).shape == (116, 200, 3)


def test_rounding(spark):
    v = [-2.5, -0.5, 0.5, 1.5, 2.5, 300.0]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select(rounding.round_half_up(F.col("v")).alias("a"), rounding.store_byte(F.col("v")).alias("b")).collect()
    assert [r["a"] for r in rows] == [-2, 0, 1, 2, 3, 300] and [r["b"] for r in rows] == [0, 0, 0, 2, 2, 255]
    texts = spark.createDataFrame([(500,), (2048,), (3 << 20,)], "v long").select(rounding.size_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in texts] == ["500 B", "2.0 KB", "3.00 MB"]


def test_searches():
    """Both searches find what trying everything finds, and ask for few sizes."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = np.sort(rng.integers(0, 1 << int(rng.integers(3, 20)), 1001))[::-1].tolist()
        asked = []

        def size_at(level, sizes=sizes, asked=asked):
            asked.append(level)
            return sizes[level]

        target = float(rng.integers(1, sizes[0] + 2))
        fitting = [level for level in range(1001) if sizes[level] <= target]
        level, size = sizing.search_level(size_at, 2 * sizes[0], target, 1000)
        assert (level, size) == (fitting[0] if fitting else 1000, sizes[fitting[0] if fitting else 1000])
        assert len(asked) == len(set(asked)) <= 40
        by_quality = lambda q, sizes=sizes: sizes[1000 - round(q * 1000)]
        good = [q for q in range(10, 101) if by_quality(q / 100) <= target]
        assert sizing.search_quality(by_quality, target) == ((max(good) if good else 10) / 100, by_quality((max(good) if good else 10) / 100))
    assert [sizing.first_level(r) for r in (8, 16, 64)] == [14, 32.5, 104.5]


def test_sampled_search(spark):
    px = synth.image(spark, "rgb_gradient", 64, 64).cache()
    codec = codecs.ProgressiveDct()
    level, size, copy = sizing.sampled_search(codec, px, "rgb_gradient", "DEVICE-001", 3300, sample=1000)
    assert size <= 3300 and codec.sizes(copy).first()["size"] == size  # so large a sample is the whole image
    above = codec.sizes(codec.compress(px, requests(spark, "rgb_gradient", ["DEVICE-001"], level=level - 1))).first()["size"]
    assert above > 3300
    other, estimate, _ = sizing.sampled_search(codec, px, "rgb_gradient", "DEVICE-001", 3300, sample=20, seed=3)
    assert estimate <= 3300 and abs(other - level) <= level


def test_all_levels(spark):
    rng = np.random.default_rng(1)
    c = [[float(x) for x in rng.normal(0, 60, 64)] for _ in range(6)] + [[0.5, -0.5, 1.0, -1.0] * 16, [0.0] * 64, [9000.0, -9000.0] * 32]
    rows = spark.createDataFrame([(k % 2, v) for k, v in enumerate(c)], "image_id int, c array<double>")
    order = [r["pos"] for r in metrics.selection_order(spark.createDataFrame([("D-1",)], "device_id string")).orderBy("order_index").collect()]
    got = {(r["image_id"], r["level"]): r["size"] for r in sizing.all_levels(rows, "D-1", F.array(*[F.lit(p) for p in order]), 300).collect()}
    for level in (0, 1, 2, 17, 63, 64, 65, 128, 200, 300):
        q = cache.quantizers(np.array(order), level)
        for image in (0, 1):
            own = [np.floor(np.array(v) / q + 0.5) for k, v in enumerate(c) if k % 2 == image]
            assert got[image, level] == 24 + sum(10 + 3 * int((z != 0).sum()) for z in own)


def test_strategy_and_preview(spark):
    manager = codecs.CodecManager("qdct")
    s = manager.strategy(spark.createDataFrame([("D",)], "device_id string")).first()["strategy"]
    assert s["device_id"] == "D" and sorted(s["quantization_order"]) == list(range(64)) and s["quantization_increase"] == 0.1
    px = synth.image(spark, "gradient", 16, 8, "i")
    coded = manager.compress(px, requests(spark, "i", DEVICES, level=5)).cache()
    assert manager.preview(coded).count() == 3 * 128 and {(r["x"], r["y"], r["r"]) for r in manager.preview(coded, most=1).collect()} == {(0, 0, 0)}


def test_reports(spark, tmp_path):
    sweep = spark.createDataFrame([("a", 0, 10, 2.0), ("a", 5, 8, 3.0), ("b", 0, 7, 1.5)], "image_id string, level int, size int, ratio double")
    reports.write_csv(sweep, str(tmp_path / "c"), "image_id")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    reports.write_json(sweep, str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j"))
    assert len(back.filter("image_id = 'a'").first()["points"]) == 2
    assert back.filter("summary IS NOT NULL").first()["summary"].asDict() == {"0": 1.75, "5": 3.0}
    full = spark.createDataFrame([("a", 64, 32, 0, 4096, 1.5, 41.256), ("a", 64, 32, 5, 1024, 6.0, 33.3), ("b", 8, 8, 0, 31, 6.19, float("inf"))], "image_id string, width int, height int, level int, size int, ratio double, psnr double")
    lines = {(r["image_id"], r["line_no"]): r["line"] for r in reports.markdown(full).collect()}
    assert lines["a", 1] == "| a | 64x32 | 6.0 KB | 1.0 KB | 6.0:1 |" and lines["a", 4] == "| 0 | 4.0 | 1.5:1 | 16.00 | 41.26 |"
    reports.write_markdown(full, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 4 + 2 + 4 + 1
    metrics.leading_rows(metrics.matrices(spark.createDataFrame([("D",), ("E",)], "device_id string"), [64]), 40).write.option("header", True).csv(str(tmp_path / "k"))
    assert [r["order_index"] for r in reports.read_matrix(spark, str(tmp_path / "k"), "D", 64).collect()] == list(range(32))
    grid = reports.pivot_grid(metrics.matrices(spark.createDataFrame([("D",)], "device_id string"), [64]))
    assert [x for r in grid.collect() for x in r[1:]] == [1 + i for i in INCREMENTS]


def test_state_in_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"D{k % 3}", k, [0.9, 0.5, 0.7, 0.2][k // 3], [float(x) for x in rng.normal(0, 50, 64)]) for k in range(12)]
    df = spark.createDataFrame(rows, "device_id string, seq long, quality double, samples array<double>")
    batch = {(r["device_id"], r["seq"]): (r["level"], r["from_cache"], r["nonzeros"]) for r in cache.fold(df).collect()}
    assert [batch["D0", k][1] for k in (0, 3, 6, 9)] == [False, True, False, True]
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    query = cache.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["device_id"], r["seq"]): (r["level"], r["from_cache"], r["nonzeros"]) for r in spark.table("answers").collect()}
    assert got == batch
