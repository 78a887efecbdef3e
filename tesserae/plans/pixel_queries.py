"""Queries of the image kernels: small pictures made from a given table, decoded and measured as files are, with SQL.

A picture of 8 x 8 pixels for each part; the colours of a pixel follow from an
MD5 of the part and the pixel's place.  Red is 1 more than a multiple of 10, green a
multiple of 10 and blue one of 5, so that no luminance lies on the border of two bins or halfway
between two levels, where the last bit of a sum would decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.views import table
from tesserae.sources import images

SIDE = 8
#: Parts whose pictures one task makes and measures: the table is small, so its splits say nothing about that work.
PER_TASK = 5_000
#: Feature names by group, in the order of the extractors.
GROUPS = {
    "brightness": ("brightness_mean", "brightness_std", "brightness_p10", "brightness_p90", "brightness_skewness"),
    "lighting": ("contrast", "highlight_threshold", "edge_strength_mean", "edge_strength_std"),
    "color": ("warm_cool_bias", "saturation_mean", "saturation_std", "warm_cool_bias_weighted", "low_saturation_ratio", "high_saturation_ratio", "dominant_hue_strength"),
    "spatial_lighting": ("light_centroid_x", "light_centroid_y", "light_spread", "light_concentration", "light_asymmetry"),
}


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, width, height, nChannels and data (B, G, R rows), as decoded files have them."""
    place = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    digests = F.transform(place, lambda i: F.md5(F.concat_ws(":", F.col("p_partkey").cast("string"), i.cast("string")).cast("binary")))
    byte = lambda h, k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    data = F.transform(digests, lambda h: F.concat(two(byte(h, 2) % 52 * 5), two(byte(h, 1) % 26 * 10), two(byte(h, 0) % 26 * 10 + 1)))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    rows = parts.repartition(-(-parts.count() // PER_TASK) or 1).select(F.col("p_partkey").cast("string").alias("path"), F.unhex(F.array_join(data, "")).alias("data"))
    return rows.select("path", *(F.lit(v).alias(k) for k, v in (("width", SIDE), ("height", SIDE), ("nChannels", 3))), "data")


N = SIDE * SIDE
_HUE = "CASE WHEN hi = lo THEN 0 ELSE ((CASE WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END * 60) % 360 + 360) % 360 END"
_LINEAR = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"
#: CTE px: path, i, y, x, r, g, b, hue, s, v, u (luminance), l (lightness); and pics: lists of u, grey levels and l by place.
_PX = f"""bytes AS (SELECT p_partkey, i, md5(p_partkey || ':' || i) AS h FROM part, LATERAL (SELECT unnest(range({N})) AS i)),
rgb AS (SELECT p_partkey::VARCHAR AS path, i, i // {SIDE} AS y, i % {SIDE} AS x, (('0x' || h[1:2])::INTEGER % 26 * 10 + 1) / 255.0::DOUBLE AS r, (('0x' || h[3:4])::INTEGER % 26 * 10) / 255.0::DOUBLE AS g, (('0x' || h[5:6])::INTEGER % 52 * 5) / 255.0::DOUBLE AS b FROM bytes),
ends AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, 0.212671 * ({_LINEAR('r')}) + 0.715160 * ({_LINEAR('g')}) + 0.072169 * ({_LINEAR('b')}) AS lum FROM rgb),
px AS MATERIALIZED (SELECT path, i, y, x, r, g, b, {_HUE} AS hue, CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END AS s, hi AS v, 0.299 * r + 0.587 * g + 0.114 * b AS u,
  round_even((CASE WHEN lum > 0.008856 THEN 116 * cbrt(lum) - 16 ELSE 903.3 * lum END) * 255 / 100, 0) / 255 AS l FROM ends),
pics AS MATERIALIZED (SELECT path, list(u ORDER BY i) AS u, list(round_even(u * 255, 0) ORDER BY i) AS q, list(l ORDER BY i) AS l FROM px GROUP BY path)"""


def _mirror(i: str) -> str:
    """A row or column beyond the border, mirrored."""
    return f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > {SIDE - 1} THEN {2 * SIDE - 2} - ({i}) ELSE {i} END)"


def _at(of: str, dy: int, dx: int) -> str:
    return f"{of}[{SIDE} * {_mirror(f'(i // {SIDE} + {dy})')} + {_mirror(f'(i % {SIDE} + {dx})')} + 1]"


def _sobel(of: str) -> str:
    a = lambda dy, dx: _at(of, dy, dx)
    dx = f"(({a(-1, 1)} + 2 * {a(0, 1)} + {a(1, 1)}) - ({a(-1, -1)} + 2 * {a(0, -1)} + {a(1, -1)}))"
    dy = f"(({a(1, -1)} + 2 * {a(1, 0)} + {a(1, 1)}) - ({a(-1, -1)} + 2 * {a(-1, 0)} + {a(-1, 1)}))"
    return f"list_transform(range({N}), lambda i: sqrt(pow({dx}, 2) + pow({dy}, 2)))"


def _quantile(of: str, p: float) -> str:
    """Between neighbours, exact where they are equal."""
    k = int(p * (N - 1))
    t = p * (N - 1) - k
    return f"(list_sort({of})[{k + 1}] + (list_sort({of})[{min(k + 2, N)}] - list_sort({of})[{k + 1}]) * {t!r})"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.feature_table(pictures(spark, sf_dir), GROUPS).drop("error")


def _features_sql() -> str:
    std = lambda of: f"sqrt(greatest(list_avg(list_transform({of}, lambda a: a * a)) - pow(list_avg({of}), 2), 0))"
    half = SIDE // 2
    side = lambda c: f"abs(avg(l) FILTER ({c} < {half}) - avg(l) FILTER ({c} >= {half}))"
    return f"""WITH {_PX},
lists AS (SELECT path, l, {_sobel('l')} AS e, {_quantile('l', 0.1)} AS p10, {_quantile('l', 0.5)} AS p50, {_quantile('l', 0.8)} AS p80, {_quantile('l', 0.9)} AS p90 FROM pics),
light AS (SELECT path, list_avg(l) AS brightness_mean, {std('l')} AS brightness_std, p10 AS brightness_p10, p90 AS brightness_p90, CASE WHEN abs(list_avg(l) - p50) < 1e-12 THEN 0 ELSE (list_avg(l) - p50) / ({std('l')} + 1e-6) END AS brightness_skewness,
  (p90 - p10) / greatest(p50, 0.01) AS contrast, p80 AS highlight_threshold, list_avg(e) AS edge_strength_mean, {std('e')} AS edge_strength_std, len(list_filter(l, lambda a: a > p80)) / {N}.0::DOUBLE AS light_concentration FROM lists),
hues AS (SELECT path, floor(hue / 15) AS bin, count(*) AS c FROM px WHERE s > 0.15 AND v > 0.08 GROUP BY ALL),
strong AS (SELECT path, CASE WHEN sum(c) >= 32 THEN max(c)::DOUBLE / sum(c) ELSE 0 END AS dominant_hue_strength FROM hues GROUP BY path),
sums AS (SELECT path, avg(r - b) AS warm_cool_bias, avg(s) AS saturation_mean, stddev_pop(s) AS saturation_std, sum((r - b) * s * sqrt(v)) / (sum(s * sqrt(v)) + 1e-6) AS warm_cool_bias_weighted,
  coalesce(avg((s < 0.12)::INTEGER::DOUBLE) FILTER (v > 0.08), 1) AS low_saturation_ratio, coalesce(avg((s > 0.55)::INTEGER::DOUBLE) FILTER (v > 0.08), 0) AS high_saturation_ratio,
  sum(l * x) / (sum(l) + 1e-6) AS cx, sum(l * y) / (sum(l) + 1e-6) AS cy, sum(l) + 1e-6 AS total, {side('x')} + {side('y')} AS light_asymmetry FROM px GROUP BY path),
spread AS (SELECT path, sqrt(sum(l * (pow(x - cx, 2) + pow(y - cy, 2))) / any_value(total)) / {SIDE} AS light_spread FROM px JOIN sums USING (path) GROUP BY path)
SELECT path, {', '.join(n for g in GROUPS.values() for n in g if n not in ('light_centroid_x', 'light_centroid_y', 'dominant_hue_strength'))}, coalesce(dominant_hue_strength, 0) AS dominant_hue_strength, cx / {SIDE} AS light_centroid_x, cy / {SIDE} AS light_centroid_y
FROM light JOIN sums USING (path) JOIN spread USING (path) LEFT JOIN strong USING (path)"""


OFF = 0.00137
QUALITY = ("blur_laplacian_var", "sharpness_score", "edge_density", "edge_mean", "edge_p95", "local_contrast_mean", "local_contrast_p95", "hue_coverage", "hue_concentration")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = images.quality_table(pictures(spark, sf_dir)).drop("error")
    # the kernel rounds these two to four digits, maybe halves; two of them tell, away from halves
    return table_.withColumns({c: F.round(F.col(c) + OFF, 2) for c in QUALITY[:2]})


def _quality_sql() -> str:
    window, sigma = 15, 0.3 * (7 - 1) + 0.8
    weights = "[" + ", ".join(f"exp(-pow({k - window // 2}, 2) / {2 * sigma**2!r})" for k in range(window)) + "]"
    rows = f"list_transform(range({N}), lambda i: list_sum(list_transform(range({window}), lambda j: k[j + 1] * u[{SIDE} * {_mirror(f'(i // {SIDE} + j - 7)')} + i % {SIDE} + 1])))"
    both = f"list_transform(range({N}), lambda i: list_sum(list_transform(range({window}), lambda j: k[j + 1] * rows[i // {SIDE} * {SIDE} + {_mirror(f'(i % {SIDE} + j - 7)')} + 1])))"
    lap = f"list_transform(range({N}), lambda i: {_at('q', -1, 0)} + {_at('q', 1, 0)} + {_at('q', 0, -1)} + {_at('q', 0, 1)} - 4 * q[i + 1])"
    var = "(list_avg(list_transform(lap, lambda a: a * a)) - pow(list_avg(lap), 2))"
    return f"""WITH {_PX},
w AS (SELECT list_transform({weights}, lambda a: a / list_sum({weights})) AS k),
one AS MATERIALIZED (SELECT path, u, k, {rows} AS rows, {lap} AS lap, {_sobel('q')} AS grad FROM pics, w),
two AS MATERIALIZED (SELECT path, lap, grad, list_transform(list_zip(u, {both}), lambda a: abs(a[1] - a[2])) AS local FROM one),
hues AS (SELECT path, count(DISTINCT floor(hue / 15)) FILTER (s > 0.12 AND v > 0.08) / 24.0::DOUBLE AS covered FROM px GROUP BY path)
SELECT path, round(round({var}, 4) + {OFF}, 2) AS blur_laplacian_var, round(round(ln(1 + {var}), 4) + {OFF}, 2) AS sharpness_score, len(list_filter(grad, lambda a: a > 0.08)) / {N}.0::DOUBLE AS edge_density, list_avg(grad) AS edge_mean, {_quantile('grad', 0.95)} AS edge_p95,
  list_avg(local) AS local_contrast_mean, {_quantile('local', 0.95)} AS local_contrast_p95, covered AS hue_coverage, 1 - covered AS hue_concentration FROM two JOIN hues USING (path)"""


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = images.histogram_bank(pictures(spark, sf_dir)).where("error IS NULL")
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v, 6).cast("decimal(9,6)").cast("string")), " ").alias(c)
    return bank.select("path", *(text(c) for c in ("brightness_hist", "saturation_hist", "hue_hist")), "hue_valid")


def _histograms_sql() -> str:
    def hist(value: str, bins: int, where: str = "true") -> str:
        return f"list_transform(range({bins}), lambda b: len(list_filter(list({value}) FILTER ({where}), lambda a: a = b)))"

    text = lambda n, total: f"array_to_string(list_transform({n}, lambda c: round(c / greatest({total}, 1)::DOUBLE, 6)::DECIMAL(9, 6)::VARCHAR), ' ')"
    return f"""WITH {_PX},
c AS (SELECT path, {hist('least(floor(u * 16), 15)', 16)} AS bn, {hist('least(floor(s * 16), 15)', 16)} AS sn, {hist('least(floor(hue / 15), 23)', 24, 's > 0.12 AND v > 0.08')} AS hn, count(*) FILTER (s > 0.12 AND v > 0.08) AS vivid FROM px GROUP BY path)
SELECT path, {text('bn', str(N))} AS brightness_hist, {text('sn', str(N))} AS saturation_hist, CASE WHEN vivid >= 32 THEN {text('hn', 'vivid')} ELSE {text('list_transform(hn, lambda a: 0)', '1')} END AS hue_hist, vivid >= 32 AS hue_valid FROM c"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness shapes beside the metadata of the same pictures."""
    return images.shapes_and_metadata(pictures(spark, sf_dir)).drop("error")


_SHAPES_SQL = f"""WITH {_PX},
bins AS (SELECT path, least(floor(l * 32), 31)::INTEGER AS bin, count(*) / {N}.0::DOUBLE AS h FROM px GROUP BY ALL),
peaks AS (SELECT path, -sum(h * ln(h + 1e-8)) AS entropy, arg_min(bin, [-h, bin::DOUBLE])::INTEGER AS peak FROM bins GROUP BY path)
SELECT path, avg((l < 0.25)::INTEGER::DOUBLE) AS dark, avg((l BETWEEN 0.25 AND 0.75)::INTEGER::DOUBLE) AS mid, avg((l > 0.75)::INTEGER::DOUBLE) AS bright, any_value(entropy) AS entropy, any_value(peak) AS peak,
  {SIDE}::INTEGER AS width, {SIDE}::INTEGER AS height, round({N} / 1e6, 4) AS megapixels, {SIDE}::INTEGER AS short_side, {SIDE}::INTEGER AS long_side, 1.0::DOUBLE AS aspect_ratio, 'square' AS orientation, false AS has_alpha, 0.0::DOUBLE AS transparent_ratio,
  avg((u > 0.98)::INTEGER::DOUBLE) AS overexposed_ratio, avg((u < 0.02)::INTEGER::DOUBLE) AS underexposed_ratio, avg((u > 0.98)::INTEGER::DOUBLE) + avg((u < 0.02)::INTEGER::DOUBLE) AS clipping_ratio
FROM px JOIN peaks USING (path) GROUP BY path"""

#: Queries by name: the function, its SQL, and the SQL's double columns.
PIXEL_QUERIES = {
    "pixel_features": (features, _features_sql(), tuple(n for g in GROUPS.values() for n in g)),
    "pixel_quality": (quality, _quality_sql(), QUALITY),
    "pixel_histograms": (histograms, _histograms_sql(), ()),
    "pixel_shapes": (shapes, _SHAPES_SQL, ("dark", "mid", "bright", "entropy", "megapixels", "aspect_ratio", "transparent_ratio", "overexposed_ratio", "underexposed_ratio", "clipping_ratio")),
}
