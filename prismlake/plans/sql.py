"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..functions.tables import INCREMENTS, LUMINANCE, ZIGZAG, waves
from .queries import COPIES, MASKED, MOST, QUALITIES, SWEEP

_LCG = "(s * 1664525 + 1013904223) % 4294967296"
_NAMES = "dev AS (SELECT DISTINCT s_name AS device_id FROM supplier)"
_NAMED = "dev AS (SELECT unnest([" + ", ".join(f"'{i}'" for _, i, _ in COPIES) + "]) AS device_id)"


def _order(dev: str) -> str:
    return f"""
{dev},
hx AS (SELECT device_id, sha256(device_id) AS h FROM dev),
inc AS (SELECT unnest(range(64)) AS pos, unnest({list(INCREMENTS)}) AS inc),
fy(device_id, i, s, o) AS (
  SELECT device_id, 63, {_LCG}, range(64) FROM (
    SELECT device_id, greatest(1, list_reduce(list_transform(range(1, 65), lambda k: ascii(substr(h, k, 1))::BIGINT), lambda a, b: (a * 31 + b) % 4294967296)) AS s FROM hx)
  UNION ALL
  SELECT device_id, i - 1, {_LCG},
    list_transform(range(64), lambda k: CASE WHEN k = i THEN o[j + 1] WHEN k = j THEN o[i + 1] ELSE o[k + 1] END)
  FROM (SELECT *, floor(s / 4294967296.0 * (i + 1))::BIGINT AS j FROM fy WHERE i > 0)),
ord AS (SELECT device_id, unnest(range(64))::INT AS order_index, unnest(o)::INT AS pos FROM fy WHERE i = 0)"""


def _matrix(levels) -> str:
    return f"""
mat AS (SELECT device_id, level::INT AS level, pos, order_index, inc::INT AS increment,
    least(255, 1 + inc * (level // 64 + CASE WHEN order_index < level % 64 THEN 1 ELSE 0 END))::INT AS value
  FROM ord JOIN inc USING (pos), (SELECT unnest({list(levels)}) AS level))"""


def _digits(start: int, n: int) -> str:
    return f"('0x' || substr(h, {start + 1}, {n}))::BIGINT"


_MASK = f"""
hx AS (SELECT device_id, sha256(device_id) AS h FROM dev),
mk(device_id, n, want, s, k) AS (
  SELECT device_id, 0, 16 + floor({_digits(0, 2)} / 255.0 * 10)::INT, greatest(1, {_digits(0, 8)}), [0::BIGINT] FROM hx
  UNION ALL
  SELECT device_id, n + 1, want, t, CASE WHEN list_contains(k, p) THEN k ELSE list_append(k, p) END
  FROM (SELECT *, {_LCG} AS t, floor(({_LCG} / 4294967296.0) * ({_LCG} / 4294967296.0) * 64)::BIGINT AS p FROM mk WHERE len(k) < want AND n < 256)),
mask AS (SELECT device_id, unnest(range(64))::INT AS position, list_contains(k, unnest(range(64))) AS kept FROM mk WHERE len(k) >= want)"""

_LUMA = f"""
lx AS (SELECT device_id, sha256(device_id) AS h FROM dev),
lm(device_id, n, s) AS (
  SELECT device_id, -1, greatest(1, {_digits(16, 8)}) FROM lx
  UNION ALL SELECT device_id, n + 1, {_LCG} FROM lm WHERE n < 63),
lum AS (SELECT device_id, n::INT AS position, greatest(1, floor(({list(LUMINANCE)})[n + 1] * (0.6 + (s / 4294967296.0) * 0.8) + 0.5))::INT AS q FROM lm WHERE n >= 0)"""

_SAMPLES = "smp AS (SELECT vec_id, label, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE * 255 AS v FROM embeddings)"
_COEF = f"""
bas AS (SELECT (8 * u + v)::INT AS k, (8 * x + y)::INT AS pos,
    0.25 * (CASE WHEN u = 0 THEN 1 / sqrt(2) ELSE 1 END) * (CASE WHEN v = 0 THEN 1 / sqrt(2) ELSE 1 END)
    * cos((2 * x + 1) * u * pi() / 16) * cos((2 * y + 1) * v * pi() / 16) AS w
  FROM range(8) a(u), range(8) b(v), range(8) c(x), range(8) d(y)),
{_SAMPLES},
coef AS (SELECT vec_id, label, k AS pos, round(sum(v * w), 9) AS c FROM smp JOIN bas USING (pos) GROUP BY vec_id, label, k)"""


def _copies(copies=COPIES) -> str:
    rows = ", ".join(f"({o}, '{i}', {v})" for o, i, v in copies)
    return f"""{_order(_NAMED)},
req(device_ord, device_id, level) AS (VALUES {rows}),
qm AS (SELECT device_ord, device_id, level, pos, least(255, 1 + inc * (level // 64 + CASE WHEN order_index < level % 64 THEN 1 ELSE 0 END))::INT AS q
  FROM req JOIN ord USING (device_id) JOIN inc USING (pos)),
{_COEF},
cp AS (SELECT vec_id, label, device_ord, device_id, level, pos, q, floor(c / q + 0.5)::INT AS z FROM coef JOIN qm USING (pos))"""


_ZIG = f"zz AS (SELECT unnest(range(64))::INT AS zig, unnest({ZIGZAG})::INT AS pos)"
_MERGED = "mg AS (SELECT vec_id, any_value(label) AS label, pos, arg_min(device_ord, q * 10 + device_ord) AS device_ord, arg_min(q * z, q * 10 + device_ord)::BIGINT AS value FROM cp GROUP BY vec_id, pos)"
_GRID = f"{_SAMPLES}, gr AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, v FROM smp)"
_HAAR = """
qd AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS a, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END) AS b,
    max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END) AS c, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) AS d FROM gr GROUP BY vec_id, y // 2, x // 2),
hb AS (SELECT vec_id, 'LL' AS band, y::BIGINT AS y, x::BIGINT AS x, (a + b + c + d) / 4 AS v FROM qd UNION ALL SELECT vec_id, 'LH', y, x, (a - b + c - d) / 4 FROM qd
  UNION ALL SELECT vec_id, 'HL', y, x, (a + b - c - d) / 4 FROM qd UNION ALL SELECT vec_id, 'HH', y, x, (a - b - c + d) / 4 FROM qd)"""
_HAAR_COPIES = f"""{_NAMED}, th AS (SELECT device_id, (('0x' || substr(sha256(device_id), 1, 8))::BIGINT % 50) / 100.0 AS t FROM dev), {_GRID}, {_HAAR},
hq AS (SELECT vec_id, band, y, x, device_id, CASE WHEN band = 'LL' THEN v WHEN abs(round(v, 9)) < 26 * (1 + t) THEN 0 ELSE floor(round(v, 9) / 26 + 0.5) * 26 END AS v FROM hb, th)"""
_SIGNAL = "sg AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS idx, floor(coalesce(value, 0) / 16)::BIGINT AS v FROM events)"
_RUNS = f"""{_SIGNAL},
ct AS (SELECT *, CASE WHEN lag(v) OVER w <> v OR (idx > 0 AND idx % 16 = 5) THEN 1 ELSE 0 END AS c FROM sg WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
nm AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY idx) AS run_no FROM ct),
rn AS (SELECT user_id, run_no::BIGINT AS run_no, min(idx) AS start, arg_min(v, idx) AS value, count(*) AS length FROM nm GROUP BY user_id, run_no)"""


def _pixels(width: int, height: int) -> str:
    return f"px AS (SELECT (i % {width})::BIGINT AS x, (i // {width})::BIGINT AS y FROM range({width * height}) t(i))"


_ALL_LEVELS = f"""{_copies(((0, "DEVICE-001", 0),))},
av AS (SELECT label, level::INT AS level, c, least(255, 1 + inc * (level // 64 + CASE WHEN order_index < level % 64 THEN 1 ELSE 0 END)) AS q
  FROM coef JOIN ord USING (pos) JOIN inc USING (pos), range({MOST + 1}) v(level) WHERE device_id = 'DEVICE-001'),
al AS (SELECT label, level, (31 + count(*) // 64 * 10 + 3 * count_if(floor(c / q + 0.5) <> 0))::BIGINT AS size FROM av GROUP BY label, level)"""

_SWEEP_CTE = f"""{_copies(tuple((k, "DEVICE-001", v) for k, v in enumerate(SWEEP)))},
sw AS (SELECT label, level, (31 + sum(n))::BIGINT AS size, count(*) * 64 * 3 / (31 + sum(n)) AS ratio
  FROM (SELECT label, level, vec_id, 10 + 3 * count_if(z <> 0) AS n FROM cp GROUP BY label, level, vec_id) GROUP BY label, level)"""
_IDCT = """
dec AS (SELECT vec_id, copy, b.pos AS pos, sum(value * w) AS b FROM every JOIN bas b ON b.k = every.pos GROUP BY vec_id, copy, b.pos)"""
_PSNR = "CASE WHEN mse = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(65025 / mse) END"
_HALF = lambda e: f"least(255, greatest(0, floor({e} + 0.5)))::INT"
_EVEN = lambda e: f"round_even(least(255, greatest(0, {e})), 0)::INT"
_CHECK8 = "((x // 8) + (y // 8)) % 2"
_IMAGES = {
    "solid": ("128", "128", "128"),
    "gradient": ("floor(x / 64.0 * 255)",) * 3,
    "checkerboard": (f"{_CHECK8} * 255",) * 3,
    "rgb_gradient": (_EVEN("x * 255 / 64.0"), _EVEN("y * 255 / 48.0"), "128"),
    "checker_gradient": (f"CASE WHEN {_CHECK8} = 1 THEN 255 ELSE {_EVEN('x * 255 / 64.0')} END", f"CASE WHEN {_CHECK8} = 1 THEN 255 ELSE {_EVEN('y * 255 / 48.0')} END", "128"),
    "scene_gradient": ("floor(x / 64.0 * 255)", "floor(y / 48.0 * 255)", "floor((x + y) / 112.0 * 255)"),
    "scene_checkerboard": ("CASE WHEN ((x // 32) + (y // 32)) % 2 = 0 THEN 255 ELSE 0 END",) * 3,
    "colorbars": tuple(f"({[int(v) * 255 for v in on]})[least(7, x // 8) + 1]" for on in ("11001100", "11110000", "10101010")),
}

_WAVE = [[repr(float(x)) for x in row[::8][:8]] for row in waves()[0][::8]]
_WAVES = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in row) + "]" for row in _WAVE) + "]"
_SCALES = "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in waves()[2]) + "]"
_BYTE = lambda i: f"least(255, greatest(0, floor(embedding[{i} + 1]::DOUBLE * 255 + 128 + 0.5)))::DOUBLE"
_PICTURES = f"""
pic AS (SELECT vec_id - vec_id % 4 AS image_id, (p % 8)::BIGINT AS x, (p // 8 + 8 * (vec_id % 4))::BIGINT AS y, {_BYTE("p")} AS r, {_BYTE("(63 - p)")} AS g, {_BYTE("((p * 5 + 3) % 64)")} AS b
  FROM embeddings, range(64) t(p)),
dim AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM pic GROUP BY image_id),
yc AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l, 128::DOUBLE - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b AS cb,
  128::DOUBLE + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b AS cr FROM pic)"""
#: Coefficients and samples, each summed term by term in one order, as the kernels do.
_CODED = f"""
wv AS (SELECT {_WAVES} AS w, {_SCALES} AS s),
sm AS (SELECT image_id, y - y % 8 AS py, ch, list(v ORDER BY y % 8, x) AS v
  FROM (SELECT image_id, x, y, unnest([1, 2, 3]) AS ch, unnest([l - 128, cb - 128, cr - 128]) AS v FROM yc) GROUP BY image_id, py, ch),
ca AS (SELECT image_id, py, ch, k::INT AS pos, list_reduce(list_transform(v, lambda e, i: e * w[(i - 1) // 8 + 1][k // 8 + 1] * w[(i - 1) % 8 + 1][k % 8 + 1]), lambda a, e: a + e) * s[k + 1] AS c
  FROM sm, wv, range(64) t(k))"""


def _decoded(source: str) -> str:
    """Pixels (image_id, copy, x, y, r, g, b) of coefficients (image_id, copy, py, ch, pos, value), and mse, their mean squared error."""
    return f"""
dl AS (SELECT image_id, copy, py, ch, list(value::DOUBLE ORDER BY pos) AS c FROM {source} GROUP BY ALL),
px AS (SELECT image_id, copy, py, ch, p::INT AS p,
    list_reduce(list_transform(c, lambda e, i: e * (w[p // 8 + 1][(i - 1) // 8 + 1] * w[p % 8 + 1][(i - 1) % 8 + 1] * s[i])), lambda a, e: a + e) AS v FROM dl, wv, range(64) t(p)),
pv AS (SELECT image_id, copy, (p % 8)::BIGINT AS x, (py + p // 8)::BIGINT AS y, max(CASE WHEN ch = 1 THEN v END) + 128 AS l, max(CASE WHEN ch = 2 THEN v END) + 128 AS cb, max(CASE WHEN ch = 3 THEN v END) + 128 AS cr FROM px GROUP BY ALL),
de AS (SELECT image_id, copy, x, y, {_HALF("l + 1.402::DOUBLE * (cr - 128)")} AS r, {_HALF("l - 0.344136::DOUBLE * (cb - 128) - 0.714136::DOUBLE * (cr - 128)")} AS g, {_HALF("l + 1.772::DOUBLE * (cb - 128)")} AS b FROM pv)"""


def _errors(pixels: str) -> str:
    return f"""(SELECT d.image_id, d.copy, round(sum((d.r - o.r) ** 2 + (d.g - o.g) ** 2 + (d.b - o.b) ** 2) / (3 * count(*)), 6) + 0.0 AS mse
      FROM {pixels} d JOIN pic o USING (image_id, x, y) GROUP BY d.image_id, d.copy)"""


_QUANTIZED = f"""
cp AS (SELECT image_id, device_ord, device_id, level, py, ch, pos, q, floor(c / q + 0.5)::BIGINT AS z FROM ca JOIN qm USING (pos))"""
_MATRICES = f"""{_order(_NAMED)},
req(device_ord, device_id, level) AS (VALUES {", ".join(f"({o}, '{i}', {v})" for o, i, v in COPIES)}),
qm AS (SELECT device_ord, device_id, level, pos, least(255, 1 + inc * (level // 64 + CASE WHEN order_index < level % 64 THEN 1 ELSE 0 END))::INT AS q
  FROM req JOIN ord USING (device_id) JOIN inc USING (pos))"""
_MASKED_COPIES = f"""{_NAMED},{_MASK},{_LUMA}, {_ZIG}, {_PICTURES},{_CODED},
req(device_ord, device_id, quality) AS (VALUES {", ".join(f"({o}, '{i}', {q}::DOUBLE)" for o, i, q in MASKED)}),
qm AS (SELECT device_ord, req.device_id, quality, lum.position AS pos, zig, (CASE WHEN quality >= 0.95 THEN greatest(4, least(16, 8 + 2 * (lum.position // 8 + lum.position % 8)))
    WHEN quality >= 0.85 THEN greatest(8, least(24, 12 + 3 * (lum.position // 8 + lum.position % 8))) WHEN quality >= 0.75 THEN greatest(12, least(32, 16 + 4 * (lum.position // 8 + lum.position % 8)))
    ELSE greatest(1, floor(q * (CASE WHEN lum.position = 0 THEN 1 + (1 - quality) * 2 ELSE 1 + (1 - quality) * 9 END) * 0.5 + 0.5)) END)::INT AS q, mask.kept AS shown,
    quality >= 0.95 OR (quality >= 0.85 AND zig < 48) OR (quality >= 0.75 AND zig < 32) OR mask.kept AS kept
  FROM req JOIN lum USING (device_id) JOIN zz ON zz.pos = lum.position JOIN mask ON mask.device_id = req.device_id AND mask.position = zz.zig),
cp AS (SELECT image_id, device_ord, quality, py, ch, pos, q, shown, CASE WHEN kept THEN floor(c / q + 0.5)::BIGINT ELSE 0 END AS z FROM ca JOIN qm USING (pos)),
late AS (SELECT * FROM cp WHERE device_ord >= 3),
fr AS (SELECT image_id, py, ch, pos, arg_max(z, quality * 100 - device_ord / 100.0) AS z FROM late WHERE z <> 0 GROUP BY ALL),
mm AS (SELECT image_id, py, ch, pos, avg(z * q) AS v FROM late WHERE z <> 0 AND shown GROUP BY ALL),
every AS (SELECT image_id, device_ord::VARCHAR AS copy, py, ch, pos, (z * q)::DOUBLE AS value FROM cp
  UNION ALL SELECT image_id, 'frequencies', py, ch, pos, (coalesce(fr.z, 0) * l.q)::DOUBLE FROM late l LEFT JOIN fr USING (image_id, py, ch, pos) WHERE device_ord = 3
  UNION ALL SELECT image_id, 'masked mean', py, ch, pos, coalesce(mm.v, 0) FROM late l LEFT JOIN mm USING (image_id, py, ch, pos) WHERE device_ord = 3),{_decoded("every")},
mg AS (SELECT image_id, 'merged' AS copy, x, y, floor(avg(r) + 0.5) AS r, floor(avg(g) + 0.5) AS g, floor(avg(b) + 0.5) AS b FROM de WHERE copy IN ('3', '4') GROUP BY ALL),
al AS (SELECT * FROM de UNION ALL SELECT * FROM mg),
sz AS (SELECT image_id, device_ord::VARCHAR AS copy, CASE WHEN max(quality) >= 0.95 THEN floor(max(width * height * 3) * 0.9::DOUBLE + 0.5) WHEN max(quality) >= 0.85 THEN floor(max(width * height * 3) * 0.65::DOUBLE + 0.5)
  WHEN max(quality) >= 0.75 THEN floor(max(width * height * 3) * 0.4::DOUBLE + 0.5) ELSE 100 + sum(CASE WHEN z <> 0 THEN 2 + length(bin(abs(z))) / 8.0 ELSE 0 END) END::DOUBLE AS size FROM cp JOIN dim USING (image_id) GROUP BY image_id, device_ord)"""
_WAVELET_COPIES = f"""{_NAMED}, th AS (SELECT device_id, (('0x' || substr(sha256(device_id), 1, 8))::BIGINT % 50) / 100.0::DOUBLE AS t FROM dev),
req(device_ord, device_id) AS (VALUES {", ".join(f"({o}, '{i}')" for o, i, _ in COPIES)}), {_PICTURES}, gr AS (SELECT image_id AS vec_id, x, y, l AS v FROM yc), {_HAAR},
hq AS (SELECT vec_id, device_ord::VARCHAR AS copy, band, y, x, CASE WHEN band = 'LL' THEN v WHEN abs(v) < 26 * (1 + t) THEN 0 ELSE floor(v / 26 + 0.5) * 26 END AS v FROM hb, req JOIN th USING (device_id)),
mn AS (SELECT vec_id, 'merged' AS copy, band, y, x, avg(v) AS v FROM hq GROUP BY ALL),
s AS (SELECT vec_id, copy, y, x, max(CASE WHEN band = 'LL' THEN v END) AS a, max(CASE WHEN band = 'LH' THEN v END) AS b, max(CASE WHEN band = 'HL' THEN v END) AS c, max(CASE WHEN band = 'HH' THEN v END) AS d
  FROM (SELECT * FROM hq UNION ALL SELECT * FROM mn) GROUP BY ALL),
sv AS (SELECT vec_id AS image_id, copy, 2 * x + dx AS x, 2 * y + dy AS y, a + (1 - 2 * dx) * b + (1 - 2 * dy) * c + (1 - 2 * dx) * (1 - 2 * dy) * d AS v FROM s, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)),
de AS (SELECT image_id, copy, x, y, {_HALF("v")} AS r, {_HALF("v")} AS g, {_HALF("v")} AS b FROM sv),
sz AS (SELECT vec_id AS image_id, copy, (100 + 2 * count_if(v <> 0))::DOUBLE AS size FROM hq GROUP BY ALL)"""
_RUN_COPIES = f"""{_NAMED}, req(device_ord, device_id, quality) AS (VALUES {", ".join(f"({o}, '{i}', {q}::DOUBLE)" for (o, i, _), q in zip(COPIES, (0.95, 0.05, 0.02), strict=True))}), {_PICTURES},
rq AS (SELECT *, CASE WHEN quality < 0.9 THEN ('0x' || substr(sha256(device_id), 1, 4))::BIGINT % 16 END AS phase, 256.0::DOUBLE / floor(2 + quality * 254 + 0.5) AS step FROM req),
qg AS (SELECT image_id, device_ord::VARCHAR AS copy, phase, x, y, y * width + x AS idx, floor(l / step) * step AS v FROM yc JOIN dim USING (image_id), rq),
ct AS (SELECT *, CASE WHEN lag(v) OVER w <> v OR (idx > 0 AND idx % 16 = phase) THEN 1 ELSE 0 END AS c FROM qg WINDOW w AS (PARTITION BY image_id, copy ORDER BY idx)),
sz AS (SELECT image_id, copy, (100 + 2 * (1 + sum(c)))::DOUBLE AS size FROM ct GROUP BY ALL),
ev AS (SELECT image_id, copy, x, y, {_EVEN("v")} AS r FROM qg),
al AS (SELECT * FROM ev UNION ALL SELECT image_id, 'merged', x, y, floor(avg(r) + 0.5) FROM ev GROUP BY ALL),
de AS (SELECT image_id, copy, x, y, r, r AS g, r AS b FROM al)"""

R = "WITH RECURSIVE "
SQL = {
    "codec_progressive": f"""{R}{_MATRICES}, {_PICTURES},{_CODED},{_QUANTIZED},
        every AS (SELECT image_id, device_ord::VARCHAR AS copy, py, ch, pos, z * q AS value FROM cp
          UNION ALL SELECT image_id, 'merged', py, ch, pos, arg_min(z * q, q * 10 + device_ord) FROM cp GROUP BY ALL),{_decoded("every")},
        sz AS (SELECT image_id, device_ord::VARCHAR AS copy, (21 + max(length(device_id)) + count(DISTINCT py) * 10 + 3 * count_if(z <> 0))::DOUBLE AS size FROM cp GROUP BY image_id, device_ord)
        SELECT image_id, copy, size, mse FROM {_errors("de")} LEFT JOIN sz USING (image_id, copy)""",
    "codec_masked": f"{R}{_MASKED_COPIES} SELECT image_id, copy, size, mse FROM {_errors('al')} LEFT JOIN sz USING (image_id, copy)",
    "codec_wavelet": f"WITH {_WAVELET_COPIES} SELECT image_id, copy, size, mse FROM {_errors('de')} LEFT JOIN sz USING (image_id, copy)",
    "codec_runs": f"WITH {_RUN_COPIES} SELECT image_id, copy, size, mse FROM {_errors('de')} LEFT JOIN sz USING (image_id, copy)",
    "nsl_roundtrip": f"""{R}{_MATRICES}, {_PICTURES},{_CODED},{_QUANTIZED}, {_ZIG}
        SELECT image_id || '/' || device_ord AS path, device_id, any_value(width)::INT AS width, any_value(height)::INT AS height, level, (36 + length(device_id) + 10 * count(DISTINCT py) + 3 * count_if(z <> 0))::BIGINT AS n_bytes,
        count_if(z <> 0)::INT AS nonzeros, sum(z * (zig + 1) * ch)::BIGINT AS mark FROM cp JOIN zz USING (pos) JOIN dim USING (image_id) GROUP BY image_id, device_ord, device_id, level""",
    "stored_size_total": f"""{R}{_copies()}, f AS (SELECT device_id, 36 + octet_length(encode(device_id)) + 10 * count(DISTINCT vec_id) + 3 * count_if(z <> 0) AS size FROM cp GROUP BY device_id)
        SELECT count(*) AS files, sum(size)::BIGINT AS size FROM f""",
    "mask_coverage_summary": f"""{R}{_NAMES},{_MASK}, c AS (SELECT position, count_if(kept)::BIGINT AS devices FROM mask GROUP BY position)
        SELECT count_if(devices > 0)::BIGINT AS covered, round(avg(devices), 6) AS average, min(devices) AS least, max(devices) AS most FROM c""",
    "increment_statistics": f"SELECT avg(v) AS average, min(v)::INT AS least, max(v)::INT AS most FROM (SELECT unnest({list(INCREMENTS)}) AS v)",
    "matrix_walk_through": f"""{R}{_order(_NAMES)},{_matrix([20, 40])} SELECT device_id, round(avg(CASE WHEN level = 20 AND order_index < 20 THEN increment END), 6) AS avg_increment,
        round(avg(CASE WHEN level = 20 THEN value END), 6) AS avg_first, round(avg(CASE WHEN level = 40 THEN value END), 6) AS avg_later FROM mat GROUP BY device_id""",
    "extreme_levels": f"""{R}{_order(_NAMES)},{_matrix([500, 1000, 5000, 16256, 20000])} SELECT device_id, level, round(avg(value), 6) AS avg_quantization, min(value) AS min_quantization, max(value) AS max_quantization FROM mat GROUP BY device_id, level""",
    "matrix_print": f"""{R}{_order(_NAMES)},{_matrix([5, 20, 64])} SELECT device_id, level, CASE WHEN value = 1 THEN 'one' WHEN value < 10 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END AS class, count(*) AS n FROM mat GROUP BY ALL""",
    "leading_rows": f"{R}{_order(_NAMES)},{_matrix([20, 40])} SELECT device_id, level, order_index, pos, value FROM mat WHERE order_index < 32",
    "matrix_grid": f"""{R}{_order("dev AS (SELECT 'DEVICE-001' AS device_id)")},{_matrix([40])} SELECT pos // 8 AS row, {", ".join(f"max(CASE WHEN pos % 8 = {c} THEN value END) AS c{c}" for c in range(8))} FROM mat GROUP BY row""",
    "device_names": "SELECT s_suppkey, 'DEVICE-' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') AS device_name FROM supplier",
    "all_level_sizes": f"{R}{_ALL_LEVELS} SELECT label, level, size FROM al",
    "level_search": f"""{R}{_ALL_LEVELS}, o AS (SELECT level, sum(size - 31)::BIGINT + 31 AS size FROM al GROUP BY level), t AS (SELECT unnest([size * 9 // 10, size * 7 // 10, size * 5 // 10])::BIGINT AS target FROM o WHERE level = 0)
        SELECT target, coalesce(min(CASE WHEN size <= target THEN level END), {MOST})::INT AS level, max(CASE WHEN size <= target THEN size END)::BIGINT AS size FROM o, t GROUP BY target""",
    "rate_table": f"""{R}{_SWEEP_CTE}, n AS (SELECT label, count(DISTINCT vec_id) AS blocks FROM coef GROUP BY label)
        SELECT label, level, round(size / 1024, 6) AS size_kb, round(ratio, 6) AS ratio, round(size * 8 / (blocks * 64), 6) AS bits_per_pixel FROM sw JOIN n USING (label)""",
    "qdct_order": f"""{R}{_order(_NAMES)} SELECT device_id, order_index, pos, pos // 8 AS row, pos % 8 AS col,
        CASE WHEN pos // 8 + pos % 8 <= 3 THEN 'low' WHEN pos // 8 + pos % 8 <= 8 THEN 'mid' ELSE 'high' END AS frequency_band FROM ord""",
    "qdct_matrix": f"{R}{_order(_NAMES)},{_matrix([0, 1, 5, 10, 20, 50, 64, 100])} SELECT * FROM mat",
    "qdct_matrix_stats": f"""{R}{_order(_NAMES)},{_matrix(range(0, 201, 5))} SELECT device_id, level, round(avg(value), 6) AS avg_quantization, min(value) AS min_quantization,
        max(value) AS max_quantization, round(stddev_pop(value), 6) AS std_deviation FROM mat GROUP BY device_id, level""",
    "theoretical_ratio": f"""{R}{_order(_NAMES)},{_matrix(range(0, 151, 2))} SELECT device_id, level, round(0.8 * avg(value), 6) AS theoretical_ratio,
        round(avg(value), 6) AS avg_quantization FROM mat GROUP BY device_id, level""",
    "device_comparison": f"""{R}{_order(_NAMES)},{_matrix(range(0, 51, 10))} SELECT device_id, level, order_index, pos AS coefficient_index, value AS quantization_value
        FROM mat WHERE order_index < least(20, level)""",
    "frequency_band_counts": f"""{R}{_order(_NAMES)} SELECT device_id, CASE WHEN pos // 8 + pos % 8 <= 3 THEN 'low' WHEN pos // 8 + pos % 8 <= 8 THEN 'mid' ELSE 'high' END AS frequency_band,
        count(*) AS n FROM ord WHERE order_index < 16 GROUP BY ALL""",
    "dct_mask": f"{R}{_NAMES},{_MASK} SELECT * FROM mask",
    "dct_mask_coverage": f"{R}{_NAMES},{_MASK} SELECT position, count_if(kept)::BIGINT AS devices FROM mask GROUP BY position",
    "dct_quant_matrix": f"{R}{_NAMES},{_LUMA} SELECT * FROM lum",
    "device_constants": f"""WITH {_NAMES}, hx AS (SELECT device_id, sha256(device_id) AS h FROM dev),
        b AS (SELECT *, {_digits(24, 2)} / 255.0 AS y, {_digits(26, 2)} / 255.0 AS cb, {_digits(28, 2)} / 255.0 AS cr FROM hx)
        SELECT device_id, h AS digest, round(y / (y + cb + cr), 6) AS w_y, round(cb / (y + cb + cr), 6) AS w_cb, round(cr / (y + cb + cr), 6) AS w_cr,
        ({_digits(30, 2)} % 4)::INT AS spatial_pattern, round(({_digits(0, 8)} % 50) / 100.0, 6) AS threshold, ({_digits(0, 4)} % 16)::INT AS phase FROM b""",
    "quality_ladder": f"""{R}{_NAMES},{_LUMA} SELECT device_id, quality::DOUBLE AS quality, position, (CASE WHEN quality >= 0.95 THEN greatest(4, least(16, 8 + 2 * (position // 8 + position % 8)))
        WHEN quality >= 0.85 THEN greatest(8, least(24, 12 + 3 * (position // 8 + position % 8))) WHEN quality >= 0.75 THEN greatest(12, least(32, 16 + 4 * (position // 8 + position % 8)))
        ELSE greatest(1, floor(q * (CASE WHEN position = 0 THEN 1 + (1 - quality) * 2 ELSE 1 + (1 - quality) * 9 END) * 0.5 + 0.5)) END)::INT AS quantizer
        FROM lum, (SELECT unnest([0.1, 0.5, 0.8, 0.9, 1.0])::DOUBLE AS quality)""",
    "matrix_heat": f"""{R}{_order(_NAMES)},{_matrix([20, 40])} SELECT device_id, level, CASE WHEN value = 1 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END AS heat,
        count(*) AS n, round(avg((value - 1) * 100.0), 6) AS avg_increase FROM mat GROUP BY ALL""",
    "block_dct": f"WITH {_COEF}, raw AS (SELECT vec_id, k, sum(v * w) AS c FROM smp JOIN bas USING (pos) GROUP BY vec_id, k) SELECT vec_id, k, round(c, 6) + 0.0 AS c FROM raw",
    "block_idct_roundtrip": f"""WITH {_COEF}, every AS (SELECT vec_id, 'a' AS copy, pos, c AS value FROM coef),{_IDCT}
        SELECT vec_id, round(max(abs(v - b)), 5) AS gap, round(any_value(e) / sum(v * v), 6) AS energy FROM dec JOIN smp USING (vec_id, pos)
        JOIN (SELECT vec_id, sum(c * c) AS e FROM coef GROUP BY vec_id) USING (vec_id) GROUP BY vec_id""",
    "zigzag_quantize": f"{R}{_copies()}, {_ZIG} SELECT vec_id, device_id, zig, z AS value FROM cp JOIN zz USING (pos) WHERE z <> 0",
    "dequantize": f"{R}{_copies()} SELECT vec_id, device_id, pos, z * q AS value FROM cp WHERE z <> 0",
    "qdct_compress_size": f"""{R}{_copies()} SELECT vec_id, device_id, (31 + length(device_id) + 3 * count_if(z <> 0))::INT AS size,
        (46 + octet_length(encode(device_id)) + 3 * count_if(z <> 0))::INT AS file_size FROM cp GROUP BY vec_id, device_id""",
    "dct_size": f"""{R}{_NAMED},{_MASK},{_LUMA}, {_COEF}, {_ZIG}, ql AS (SELECT unnest({list(QUALITIES)})::DOUBLE AS quality),
        qt AS (SELECT position AS pos, quality, greatest(1, floor(q * (CASE WHEN position = 0 THEN 1 + (1 - quality) * 2 ELSE 1 + (1 - quality) * 9 END) * 0.5 + 0.5)) AS q FROM lum, ql WHERE device_id = 'DEVICE-001'),
        zc AS (SELECT vec_id, quality, CASE WHEN kept THEN floor(c / q + 0.5)::BIGINT ELSE 0 END AS z FROM coef JOIN qt USING (pos) JOIN zz USING (pos)
          JOIN mask ON mask.position = zz.zig AND mask.device_id = 'DEVICE-001')
        SELECT vec_id, quality, round(100 + sum(CASE WHEN z <> 0 THEN 2 + ceil(log2(abs(z) + 1)) / 8 ELSE 0 END), 6) AS size FROM zc GROUP BY vec_id, quality""",
    "qdct_reconstruct": f"{R}{_copies()}, {_MERGED} SELECT vec_id, pos, device_ord, value FROM mg",
    "psnr_by_label": f"""{R}{_copies()}, {_MERGED}, every AS (SELECT vec_id, device_id AS copy, pos, q * z AS value FROM cp UNION ALL SELECT vec_id, 'merged', pos, value FROM mg),{_IDCT},
        e AS (SELECT label, copy, avg((v - b) * (v - b)) AS mse FROM dec JOIN smp USING (vec_id, pos) GROUP BY label, copy)
        SELECT label, copy, round(mse, 5) AS mse, round({_PSNR}, 4) AS psnr FROM e""",
    "dct_freq_reconstruct": f"""{R}{_copies()}, n AS (SELECT *, greatest(0.01, 1 - least(level, 63) / 63.0) AS quality FROM cp WHERE z <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, pos ORDER BY quality DESC, device_ord) AS k FROM n) SELECT vec_id, pos, device_ord, z AS value FROM r WHERE k = 1""",
    "haar_forward": f"WITH {_GRID}, {_HAAR} SELECT vec_id, band, y, x, round(v, 6) + 0.0 AS v FROM hb",
    "haar_quantize": f"WITH {_HAAR_COPIES} SELECT vec_id, band, y, x, device_id, round(v, 6) + 0.0 AS v FROM hq WHERE v <> 0",
    "haar_sizes": f"WITH {_HAAR_COPIES} SELECT vec_id, device_id, 100 + 2 * count_if(v <> 0)::BIGINT AS size FROM hq GROUP BY vec_id, device_id",
    "haar_reconstruct": f"""WITH {_HAAR_COPIES}, mn AS (SELECT vec_id, band, y, x, avg(v) AS v FROM hq GROUP BY ALL),
        s AS (SELECT vec_id, y, x, max(CASE WHEN band = 'LL' THEN v END) AS a, max(CASE WHEN band = 'LH' THEN v END) AS b, max(CASE WHEN band = 'HL' THEN v END) AS c, max(CASE WHEN band = 'HH' THEN v END) AS d FROM mn GROUP BY ALL)
        SELECT vec_id, 2 * y + dy AS y, 2 * x + dx AS x, round(a + (1 - 2 * dx) * b + (1 - 2 * dy) * c + (1 - 2 * dx) * (1 - 2 * dy) * d, 5) + 0.0 AS v FROM s, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)""",
    "rle_runs": f"WITH {_RUNS} SELECT * FROM rn",
    "rle_expand": f"WITH {_SIGNAL} SELECT user_id, idx::BIGINT AS idx, v FROM sg",
    "rle_reconstruct": f"WITH {_SIGNAL} SELECT user_id, idx::BIGINT AS idx, v FROM sg",
    "rle_sizes": f"WITH {_RUNS} SELECT user_id, 100 + 2 * count(*) AS size FROM rn GROUP BY user_id",
    "rgb_ycbcr": f"""WITH px AS (SELECT (i % 64)::BIGINT AS x, (i // 64)::BIGINT AS y FROM range(4096) t(i)), c AS (SELECT x, y, {_EVEN('x * 255 / 64.0')} AS r, {_EVEN('y * 255 / 64.0')} AS g, 128 AS b FROM px),
        k AS (SELECT x, y, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l, 128 - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b AS cb, 128 + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b AS cr FROM c)
        SELECT x, y, round(l, 6) AS luma, round(cb, 6) AS cb, round(cr, 6) AS cr, {_HALF('l + 1.402::DOUBLE * (cr - 128)')} AS r2,
        {_HALF('l - 0.344136::DOUBLE * (cb - 128) - 0.714136::DOUBLE * (cr - 128)')} AS g2, {_HALF('l + 1.772::DOUBLE * (cb - 128)')} AS b2 FROM k""",
    "difference_image": f"WITH {_pixels(32, 32)}, d AS (SELECT x, y, least(255, 5 * abs(floor(x / 32.0 * 255)::INT - ({_CHECK8} * 255)::INT))::INT AS r FROM px) SELECT x, y, r, r AS g, r AS b FROM d",
    "synthetic_images": f"WITH {_pixels(64, 48)}, im AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS image_id, x, y, ({r})::BIGINT AS r, ({g})::BIGINT AS g, ({b})::BIGINT AS b FROM px" for n, (r, g, b) in _IMAGES.items())
    + ") SELECT image_id, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, sum(r * (x + 1) + g * (y + 1))::BIGINT AS moment FROM im GROUP BY image_id",
    "median_merge": f"WITH {_pixels(32, 32)}, e AS (SELECT x, y, list_sort([floor(x / 32.0 * 255)::DOUBLE, ({_CHECK8} * 255)::DOUBLE, 128.0::DOUBLE])[2] AS r FROM px) SELECT x, y, r, r AS g, r AS b FROM e",
    "image_psnr": f"WITH {_pixels(32, 32)}, e AS (SELECT avg((floor(x / 32.0 * 255) - 128) * (floor(x / 32.0 * 255) - 128)) AS mse FROM px) SELECT round(mse, 6) AS mse, round({_PSNR}, 6) AS psnr FROM e",
    "level_sweep": f"{R}{_SWEEP_CTE} SELECT label, level, size, round(ratio, 6) AS ratio FROM sw",
    "ratio_by_level": f"{R}{_SWEEP_CTE} SELECT level, round(avg(ratio), 6) AS avg_ratio FROM sw GROUP BY level",
    "min_size_max_ratio": f"{R}{_SWEEP_CTE} SELECT label, min(size) AS min_size, round(max(ratio), 6) AS max_ratio FROM sw GROUP BY label",
    "size_target_setbased": f"{R}{_ALL_LEVELS} SELECT label, min(level) AS level, arg_min(size, level) AS size FROM al WHERE size <= 5500 GROUP BY label",
    "memory_limit_setbased": f"""{R}{_ALL_LEVELS}, q AS (SELECT *, round(greatest(0.01, 1 - least(level, 63) / 63.0), 6) AS quality FROM al)
        SELECT label, quality, max(size) AS size FROM (SELECT *, max(quality) OVER (PARTITION BY label) AS best FROM q WHERE size <= 6000) WHERE quality = best GROUP BY label, quality""",
    "level_estimate": """WITH r AS (SELECT p_partkey, p_retailprice / 25.0::DOUBLE AS r, floor(p_retailprice * 3000)::BIGINT AS b FROM part)
        SELECT p_partkey, round(CASE WHEN r < 5 THEN 1.25 * (r - 1) WHEN r < 15 THEN 2.0 * (r - 1) ELSE 1.5 * (r - 1) + 10 END, 6) AS level,
        floor((1.0::DOUBLE - least(1.0::DOUBLE, r / 100)) * 63 + 0.5)::INT AS quality_level,
        CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.2f', floor(b / 1048576.0::DOUBLE * 100 + 0.5) / 100) || ' MB' END AS size_text FROM r""",
}
