"""Device strategies: fixed expected values and invariants."""

from pyspark.sql import functions as F

from prismlake.functions import strategy as st
from prismlake.operators import metrics


def devices(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "device_id string")


def test_order_and_levels(spark):
    one = devices(spark, "DEVICE-001")
    order = [r["pos"] for r in metrics.selection_order(one).orderBy("order_index").collect()]
    assert order[:4] == [2, 47, 5, 58] and sorted(order) == list(range(64))
    stats = {r["level"]: r for r in metrics.matrix_statistics(metrics.matrices(one, [0, 5, 10, 15, 50, 100, 200])).collect()}
    want = {0: (1.00, 1, 1, 0.00), 5: (1.83, 1, 20, 3.40), 10: (2.92, 1, 23, 5.27), 15: (3.98, 1, 25, 6.55)}
    for level, (avg, lo, hi, dev) in want.items():
        r = stats[level]
        assert (r["min_quantization"], r["max_quantization"]) == (lo, hi)
        assert abs(r["avg_quantization"] - avg) <= 0.0051 and abs(r["std_deviation"] - dev) <= 0.0051
    for level, avg in ((50, 10.44), (100, 19.69), (200, 38.03)):
        assert abs(stats[level]["avg_quantization"] - avg) <= 0.0051
    lead = metrics.leading_quantizers(metrics.matrices(one, [10])).orderBy("order_index").limit(4).collect()
    assert [(r["coefficient_index"], r["quantization_value"]) for r in lead] == [(2, 4), (47, 19), (5, 9), (58, 20)]


def test_matrix_forms_agree(spark):
    rows = devices(spark, "A", "B", "").withColumn("level", F.explode(F.array(*[F.lit(v) for v in (-3, 0, 1, 63, 64, 100, 20000)])))
    arrays = rows.select("device_id", "level", F.posexplode(st.quantizer_matrix(st.quantization_order(F.col("device_id")), F.col("level"))).alias("pos", "a"))
    long = metrics.matrices(rows.select("device_id").distinct(), [-3, 0, 1, 63, 64, 100, 20000])
    assert arrays.join(long, ["device_id", "level", "pos"]).filter("a <> value").count() == 0
    assert long.filter("level <= 0 AND value <> 1").count() == 0 and long.agg(F.max("value")).first()[0] == 255


def test_mask_matrix_weights(spark):
    names = ["camera north", "camera south", "phone/12", "drone-\u00fc", "", "long " * 300, "tab\tand\nline"]
    rows = devices(spark, *names).select("device_id", st.dct_strategy(F.col("device_id")).alias("s")).collect()
    for r in rows:
        s = r["s"]
        kept = s["frequency_mask"]
        assert kept[0] and 16 <= sum(kept) <= 26
        assert all(1 <= q <= 255 for q in s["quant"]) and abs(sum(s["weights"]) - 1) < 1e-12 and 0 <= s["spatial_pattern"] <= 3
    assert sum(sum(r["s"]["frequency_mask"][:32]) for r in rows) > sum(sum(r["s"]["frequency_mask"][32:]) for r in rows)
    cover = {r["position"]: r["devices"] for r in metrics.mask_coverage(devices(spark, *names[:4])).collect()}
    assert cover[0] == 4 and sum(v > 0 for v in cover.values()) > 40
    assert devices(spark, "DEVICE-001").select(st.digest(F.col("device_id"))).first()[0].startswith("7baec53f")
