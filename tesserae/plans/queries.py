"""The registered queries of the engine's operators; where SQL can say the same, it stands beside them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import labels, scalars
from tesserae.functions.config import FEATURE_GROUPS, FEATURES, SINGLE_RULES, TARGET_RANGES, LabelConfig
from tesserae.operators import calibrate, cart, channels, cluster, dedup, experiments, export, histogram, metrics, naming, overlay, quality, sampling, slices, stats
from tesserae.operators.graph import cut
from tesserae.plans import views
from tesserae.plans.pixel_queries import PIXEL_QUERIES
from tesserae.plans.views import BANK_SQL, FEATURES_SQL, HASHES_CTE, METADATA_SQL, PART_HISTOGRAM_SQL, QUALITY_SQL, table
from tesserae.sources import copies, storage
from tesserae.sources.previews import Previews
from tesserae.streaming import jobs

DIGITS = 6
#: Thresholds that differ from the defaults, to compare configurations on the views.
SHIFTED = LabelConfig(low_key_dark_ratio=0.20, high_key_bright_ratio=0.20, muted_low_sat_ratio=0.50, vivid_high_sat_ratio=0.10, warm_ratio=0.20, cool_ratio=0.60, mixed_color_entropy=3.8, flat_light_entropy=3.2)


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    #: Double columns of the SQL; they are rounded on both sides.
    doubles: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.withColumns({c: F.round(c, DIGITS) for c, t in df.dtypes if t in ("double", "float")})

    def oracle(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) AS {c}' for c in self.doubles)}) FROM ({self.sql})"


def _query(sql: str | None = None, *doubles: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = Query(f, sql, doubles)
        return f

    return register


QUERIES: dict[str, Query] = {}
NAMES = list(FEATURES)
_LIST = ", ".join(f"('{n}', {n})" for n in NAMES)
_MELT = f"melted AS (SELECT vec_id, cluster_id, u.feature, u.value FROM feats, LATERAL (VALUES {_LIST}) u(feature, value))"
_FEATS = f"WITH feats AS ({FEATURES_SQL}), {_MELT} "


# ---- histogram channel ------------------------------------------------------------------------------------------


def _summary_sql(config: LabelConfig = LabelConfig()) -> str:
    """CTEs bank, stats, z and summary."""
    stat, zs, outs = [], [], []
    for n, (_, _, _, bins) in views.BANK.items():
        stat += [f"[{', '.join(f'{f}({n}[{b + 1}])' for b in range(bins))}] AS {n}_{k}" for k, f in (("m", "avg"), ("s", "stddev_pop"))]
        zs.append(f"list_transform(range(1, {bins + 1}), lambda i: ({n}[i] - {n}_m[i]) / ({n}_s[i] + 1e-6)) AS {n}_z")
        outs.append(f"sqrt(list_sum(list_transform({n}_z, lambda x: x * x))) AS {n}_outlier")
    part = lambda h, a, b: f"list_sum({h}[{a + 1}:{b}])"
    ent = lambda h: f"-list_sum(list_transform({h}, lambda x: (x + 1e-6) * log2(x + 1e-6)))"
    b, s, h = views.BANK
    has = f"hue_valid AND list_sum({h}) > 0"
    raw = f"""{part(b, 0, 4)} AS brightness_dark_ratio, {part(b, 4, 12)} AS brightness_midtone_ratio, {part(b, 12, 16)} AS brightness_bright_ratio,
{ent(b)} AS brightness_entropy, len(list_filter({b}, lambda x: x > list_sum({b}) / 16 * 1.5))::INTEGER AS brightness_peak_count, {b}_outlier AS brightness_outlier_score,
{part(s, 0, 4)} AS saturation_low_ratio, {part(s, 4, 12)} AS saturation_mid_ratio, {part(s, 12, 16)} AS saturation_high_ratio, {ent(s)} AS saturation_entropy, {s}_outlier AS saturation_outlier_score,
CASE WHEN {has} THEN {part(h, 0, 5)} ELSE 0 END AS hue_warm_ratio, CASE WHEN {has} THEN {part(h, 11, 21)} ELSE 0 END AS hue_cool_ratio,
CASE WHEN hue_valid THEN {ent(h)} ELSE 0 END AS hue_entropy, (CASE WHEN {has} THEN list_position({h}, list_max({h})) - 1 ELSE -1 END)::INTEGER AS hue_dominant_bin,
{h}_outlier AS hue_outlier_score, sqrt({b}_outlier ** 2 + {s}_outlier ** 2 + {h}_outlier ** 2) AS histogram_outlier_score"""
    return f"""bank AS MATERIALIZED ({BANK_SQL}), stats AS (SELECT {', '.join(stat)} FROM bank), z AS (SELECT bank.*, {', '.join(zs)} FROM bank, stats),
outs AS (SELECT *, {', '.join(outs)} FROM z), measures AS MATERIALIZED (SELECT vec_id, image_path, source, hue_valid, {raw} FROM outs),
masks AS MATERIALIZED (SELECT *, {_masks_sql(config)} FROM measures),
summary AS MATERIALIZED (SELECT * EXCLUDE ({', '.join('m_' + k for k in RULES)}), {_join_sql()} AS labels FROM masks)"""


RULES = list(labels.LABELS)


def _masks_sql(c: LabelConfig, prefix: str = "m_") -> str:
    rules = {
        "low_key": f"brightness_dark_ratio > {c.low_key_dark_ratio}",
        "high_key": f"brightness_bright_ratio > {c.high_key_bright_ratio}",
        "high_contrast": f"brightness_dark_ratio > {c.high_contrast_dark_ratio} AND brightness_bright_ratio > {c.high_contrast_bright_ratio}",
        "flat_light": f"brightness_entropy < {c.flat_light_entropy}",
        "muted": f"saturation_low_ratio > {c.muted_low_sat_ratio}",
        "vivid": f"saturation_high_ratio > {c.vivid_high_sat_ratio}",
        "warm": f"hue_valid AND hue_warm_ratio > {c.warm_ratio}",
        "cool": f"hue_valid AND hue_cool_ratio > {c.cool_ratio}",
        "mixed_color": f"hue_valid AND hue_entropy > {c.mixed_color_entropy}",
        "lineart_like_candidate": f"brightness_bright_ratio > {c.lineart_bright_ratio} AND saturation_low_ratio > {c.lineart_low_sat_ratio} AND brightness_dark_ratio > {c.lineart_dark_ratio}",
    }
    return ", ".join(f"({v}) AS {prefix}{k}" for k, v in rules.items())


def _join_sql(prefix: str = "m_", empty: str = "unclassified", names: list[str] | None = None) -> str:
    parts = ", ".join(f"CASE WHEN {prefix}{k} THEN '{k}' END" for k in names or RULES)
    return f"coalesce(nullif(concat_ws(';', {parts}), ''), '{empty}')"


MEASURES = (
    "brightness_dark_ratio", "brightness_midtone_ratio", "brightness_bright_ratio", "brightness_entropy", "brightness_outlier_score",
    "saturation_low_ratio", "saturation_mid_ratio", "saturation_high_ratio", "saturation_entropy", "saturation_outlier_score",
    "hue_warm_ratio", "hue_cool_ratio", "hue_entropy", "hue_outlier_score", "histogram_outlier_score",
)


def _channel(spark: SparkSession, sf_dir: str, digits: int | None = DIGITS) -> DataFrame:
    full = histogram.summary(_with_residuals(spark, sf_dir), digits=digits)
    return full.select("vec_id", "image_path", "source", "hue_valid", *MEASURES, "brightness_peak_count", "hue_dominant_bin", "labels")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel unrounded: a ratio that is a threshold's neighbour must not become the threshold."""
    return _channel(spark, sf_dir, None)


def _with_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.all_residuals(views.bank(spark, sf_dir), {n: bins for n, (_, _, _, bins) in views.BANK.items()})


@_query(f"WITH {_summary_sql()} SELECT * FROM summary", *MEASURES)
def histogram_summary(spark, sf_dir):
    return _channel(spark, sf_dir)


@_query(f"WITH {_summary_sql()} SELECT vec_id, labels, histogram_outlier_score FROM summary ORDER BY round(histogram_outlier_score, 6) DESC, vec_id LIMIT 100", "histogram_outlier_score")
def histogram_outlier_slice(spark, sf_dir):
    df = histogram.summary(_with_residuals(spark, sf_dir), digits=DIGITS)
    return df.select("vec_id", "labels", "histogram_outlier_score").orderBy(*slices.order("histogram_outlier_score", True, "vec_id")).limit(100)


_bins = "SELECT unnest(range(16))::INTEGER AS bin, unnest([" + ", ".join(f"avg(brightness_hist[{b + 1}])" for b in range(16)) + "]) AS mean, unnest([" + ", ".join(f"stddev_pop(brightness_hist[{b + 1}])" for b in range(16)) + "]) AS std FROM bank"


@_query(f"WITH bank AS ({BANK_SQL}) {_bins}", "mean", "std")
def histogram_bin_stats(spark, sf_dir):
    rows = views.bank(spark, sf_dir).select(F.posexplode("brightness_hist").alias("bin", "v"))
    return rows.groupBy("bin").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def _rates_sql(by: str = "") -> str:
    avgs = ", ".join(f"('{k}', m_{k})" for k in RULES)
    none = " OR ".join(f"m_{k}" for k in RULES if k != "lineart_like_candidate")
    return f"SELECT {by} u.label, avg(u.hit::INTEGER::DOUBLE) AS rate FROM masks, LATERAL (VALUES {avgs}, ('unclassified', NOT ({none}))) u(label, hit)"


@_query(f"WITH {_summary_sql()} {_rates_sql()} GROUP BY u.label", "rate")
def label_rates(spark, sf_dir):
    return calibrate.label_rates(_measured(spark, sf_dir))


@_query(f"WITH {_summary_sql()} {_rates_sql('source,')} GROUP BY GROUPING SETS ((source, u.label), (u.label))", "rate")
def label_rates_by_source(spark, sf_dir):
    return calibrate.label_rates(_measured(spark, sf_dir), source="source")


@_query(f"WITH {_summary_sql()}, m AS (SELECT u.label, u.hit FROM masks, LATERAL (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, m_{k})' for k in RULES)}) u(label, hit)), r AS (SELECT label, avg(hit::INTEGER::DOUBLE) AS rate FROM m GROUP BY label) SELECT label, rate, CASE WHEN rate > 0.7 THEN 'too_loose' ELSE 'too_tight' END AS warning FROM r WHERE rate > 0.7 OR rate < 0.01", "rate")
def label_warnings(spark, sf_dir):
    return calibrate.warnings(calibrate.label_rates(_measured(spark, sf_dir)).where("label != 'unclassified'"))


_two = f"WITH {_summary_sql()}, two AS (SELECT masks.*, {_masks_sql(SHIFTED, 'n_')} FROM masks)"
_sorted = lambda p: f"list_sort(list_filter([{', '.join(f'CASE WHEN {p}{k} THEN {chr(39)}{k}{chr(39)} END' for k in RULES)}], lambda x: x IS NOT NULL))"


@_query(f"""{_two}, s AS (SELECT vec_id, {_sorted('m_')} AS o, {_sorted('n_')} AS n FROM two),
d AS (SELECT vec_id, o, n, list_filter(n, lambda x: NOT list_contains(o, x)) AS a, list_filter(o, lambda x: NOT list_contains(n, x)) AS r FROM s)
SELECT vec_id, coalesce(nullif(array_to_string(o, ';'), ''), 'unclassified') AS labels_default, coalesce(nullif(array_to_string(n, ';'), ''), 'unclassified') AS labels_suggested,
array_to_string(a, ';') AS added_labels, array_to_string(r, ';') AS removed_labels, (len(a) + len(r))::INTEGER AS changed_label_count FROM d WHERE len(a) + len(r) > 0""")
def label_ab_diff(spark, sf_dir):
    return calibrate.compare(_measured(spark, sf_dir), LabelConfig(), SHIFTED, "vec_id")


@_query(f"{_two} SELECT u.* FROM (SELECT {', '.join(f'count(*) FILTER (m_{k}) AS a_{k}, count(*) FILTER (n_{k}) AS b_{k}, count(*) FILTER (NOT m_{k} AND n_{k}) AS c_{k}, count(*) FILTER (m_{k} AND NOT n_{k}) AS d_{k}' for k in RULES)} FROM two), LATERAL (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, a_{k}, b_{k}, c_{k}, d_{k})' for k in RULES)}) u(label, count_default, count_suggested, added, removed)")
def label_ab_counts(spark, sf_dir):
    return calibrate.compare_counts(_measured(spark, sf_dir), LabelConfig(), SHIFTED)


_axis = lambda at: [max(0.10, at - 0.10) + k * 0.025 for k in range(100) if max(0.10, at - 0.10) + k * 0.025 < min(0.50, at + 0.10) + 0.001]
_grid = f"(VALUES {', '.join(f'({d!r}::DOUBLE, {b!r}::DOUBLE)' for d in _axis(0.2124) for b in _axis(0.2005))}) g(dark, bright)"


@_query(f"WITH {_summary_sql()}, r AS (SELECT dark, bright, avg((brightness_dark_ratio > dark AND brightness_bright_ratio > bright)::INTEGER::DOUBLE) AS rate FROM measures, {_grid} GROUP BY ALL) SELECT dark, bright, rate, CASE WHEN rate < 0.02 THEN (0.02 - rate) ** 2 * 100 WHEN rate > 0.15 THEN (rate - 0.15) ** 2 * 100 ELSE 0 END AS score FROM r", "dark", "bright", "rate", "score")
def contrast_grid(spark, sf_dir):
    return calibrate.contrast_grid(_measured(spark, sf_dir))


@_query(f"WITH {_summary_sql()} SELECT vec_id, labels, hue_warm_ratio FROM summary WHERE list_contains(string_split(labels, ';'), 'cool') ORDER BY round(hue_warm_ratio, 6) DESC, image_path LIMIT 20 OFFSET 5", "hue_warm_ratio")
def label_filtered_page(spark, sf_dir):
    rows, _ = slices.page(_channel(spark, sf_dir), {"hue_warm_ratio"}, "hue_warm_ratio", label="cool", limit=20, offset=5)
    return rows.select("vec_id", "labels", "hue_warm_ratio")


def _slices_sql(channel: str, rows: str) -> str:
    parts = [
        f"(SELECT '{s.name}' AS slice, row_number() OVER w AS rank, image_path FROM {rows} {'WHERE ' + s.where if s.where else ''} WINDOW w AS (ORDER BY round({s.field}, 6) {'DESC' if s.descending else 'ASC'} NULLS LAST, image_path) QUALIFY rank <= {s.limit})"
        for s in slices.CATALOGUE.values()
        if s.channel == channel
    ]
    return " UNION ALL ".join(parts)


def _slices(rows: DataFrame, channel: str) -> DataFrame:
    rows = cut(rows.withColumns({c: F.round(c, DIGITS) for c, t in rows.dtypes if t == "double"}))
    return slices.take_all(rows, [s for s in slices.CATALOGUE.values() if s.channel == channel and slices.available(s, rows.columns)])


@_query(f"WITH {_summary_sql()} {_slices_sql('histogram', 'summary')}")
def slices_histogram(spark, sf_dir):
    return _slices(_channel(spark, sf_dir), "histogram")


@_query(f"WITH m AS ({METADATA_SQL}) {_slices_sql('basic_metadata', 'm')}")
def slices_metadata(spark, sf_dir):
    return _slices(views.metadata(spark, sf_dir), "basic_metadata")


# ---- quality channel --------------------------------------------------------------------------------------------

_QUALITY = f"""WITH q AS ({QUALITY_SQL}), h AS ({PART_HISTOGRAM_SQL}),
j AS (SELECT q.*, h.image_path IS NOT NULL AS _hist_found, coalesce(brightness_bright_ratio, 0.3) AS b, coalesce(brightness_dark_ratio, 0.3) AS d, coalesce(saturation_low_ratio, 0.5) AS s, least(edge_density * 5, 1) AS e, least(local_contrast_p95 * 20, 1) AS c FROM q LEFT JOIN h USING (image_path)),
scored AS (SELECT image_path, blur_laplacian_var, sharpness_score, edge_density, local_contrast_p95, peak, _hist_found, round(0.35 * b + 0.25 * s + 0.25 * e + 0.15 * c, 9) AS lineart_score_v2, round(0.3 * d + 0.3 * b + 0.2 * c + 0.2 * e, 9) AS high_contrast_score_v2, round(1 - least((e + c) / 2, 1), 9) AS flat_color_score FROM j),
lim AS (SELECT quantile_cont(sharpness_score, 0.1) AS t FROM scored),
marked AS (SELECT scored.*, sharpness_score < t AS m_blurry, sharpness_score > 4 AS m_sharp, edge_density > 0.15 AS m_edge_heavy, lineart_score_v2 > 0.55 AS m_lineart_v2, high_contrast_score_v2 > 0.55 AS m_high_contrast_v2 FROM scored, lim),
channel AS (SELECT * EXCLUDE (m_blurry, m_sharp, m_edge_heavy, m_lineart_v2, m_high_contrast_v2), {_join_sql(empty='normal', names=['blurry', 'sharp', 'edge_heavy', 'lineart_v2', 'high_contrast_v2'])} AS labels, m_blurry AS is_blurry_candidate FROM marked)"""


def _quality(spark, sf_dir):
    return quality.channel(views.quality(spark, sf_dir), views.part_histogram(spark, sf_dir), 9)


@_query(f"{_QUALITY} SELECT * FROM channel", "blur_laplacian_var", "sharpness_score", "edge_density", "local_contrast_p95", "peak", "lineart_score_v2", "high_contrast_score_v2", "flat_color_score")
def quality_channel(spark, sf_dir):
    return _quality(spark, sf_dir)


@_query(f"{_QUALITY} {_slices_sql('quality_edge', 'channel')}")
def slices_quality(spark, sf_dir):
    return _slices(_quality(spark, sf_dir), "quality_edge")


@_query(f"{_QUALITY} SELECT label, count(*) AS n FROM (SELECT unnest(string_split(labels, ';')) AS label FROM channel) GROUP BY label")
def quality_label_counts(spark, sf_dir):
    return _quality(spark, sf_dir).select(F.explode(F.split("labels", ";")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# ---- duplicates -------------------------------------------------------------------------------------------------

_EXACT = "exact AS (SELECT doc_id AS path, min(doc_id) OVER w AS group_id, count(*) OVER w AS image_count, octet_length(encode(text)) AS file_size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY sha256(text)) QUALIFY count(*) OVER w > 1)"
_HITS = " + ".join(f"CASE WHEN coalesce(bit_count(xor(x.{n}, y.{n})), 999) <= {t} THEN 1 ELSE 0 END" for n, t in dedup.THRESHOLDS.items())
_D = ", ".join(f"coalesce(bit_count(xor(x.{n}, y.{n})), 999)::INTEGER AS d_{n}" for n in dedup.THRESHOLDS)
_CLASSES = f"{HASHES_CTE}, classes AS MATERIALIZED (SELECT min(id) AS id, phash, dhash, whash, colorhash, count(*) AS copies FROM hashes GROUP BY phash, dhash, whash, colorhash)"
_PAIRS = f"{_CLASSES}, pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b, {_D}, ({_HITS})::INTEGER AS hits FROM classes x JOIN classes y ON x.id < y.id WHERE {_HITS} >= 2)"
_ROOTS = """sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS root FROM sym UNION SELECT sym.b AS id, reach.root FROM reach JOIN sym ON sym.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


#: The default rule over hashes of the views' width.
RULE = dedup.PairRule(bits=views.HASH_BITS)


@_query(f"WITH {_EXACT} SELECT file_size::INTEGER AS file_size, sha256, path, group_id, image_count FROM exact")
def exact_duplicates(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(f"WITH {_PAIRS} SELECT * FROM pairs")
def perceptual_pairs(spark, sf_dir):
    return dedup.near_pairs(dedup.hash_classes(views.hashes(spark, sf_dir), RULE), RULE)


@_query(f"WITH RECURSIVE {_CLASSES}, p AS (SELECT x.id AS a, y.id AS b FROM classes x JOIN classes y ON x.id < y.id WHERE coalesce(bit_count(xor(x.phash, y.phash)), 999) <= 6) SELECT a, b FROM p")
def single_hash_pairs(spark, sf_dir):
    rule = dedup.PairRule((("phash", 6),), 1, views.HASH_BITS)
    hashes = views.hashes(spark, sf_dir)
    full = dedup.hash_classes(hashes, RULE).select("id", "phash")
    return dedup.near_pairs(full, rule).select("a", "b")


@_query(f"""WITH RECURSIVE {_PAIRS}, {_ROOTS}, named AS (SELECT h.id, coalesce(r.root, c.id) AS group_id FROM hashes h JOIN classes c ON h.phash IS NOT DISTINCT FROM c.phash AND h.dhash IS NOT DISTINCT FROM c.dhash AND h.whash IS NOT DISTINCT FROM c.whash AND h.colorhash IS NOT DISTINCT FROM c.colorhash LEFT JOIN roots r ON r.id = c.id)
SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS image_count FROM named QUALIFY count(*) OVER (PARTITION BY group_id) > 1""")
def perceptual_groups(spark, sf_dir):
    return dedup.perceptual_groups(views.hashes(spark, sf_dir), RULE)


@_query(f"""WITH RECURSIVE {_PAIRS}, {_ROOTS} SELECT root AS group_id, array_to_string(list_sort(list_distinct(flatten(list(hit)))), ';') AS hit_evidence FROM
(SELECT root, list_filter([{', '.join(f"CASE WHEN d_{n} <= {t} THEN '{n}' END" for n, t in dedup.THRESHOLDS.items())}], lambda x: x IS NOT NULL) AS hit FROM pairs JOIN roots ON roots.id = pairs.a) GROUP BY root""")
def duplicate_evidence(spark, sf_dir):
    links = storage.written(dedup.near_links(dedup.hash_classes(views.hashes(spark, sf_dir), RULE), RULE), "links")
    found = dedup.evidence(links, dedup.components(links), RULE)
    return found.select("group_id", F.array_join("hit_evidence", ";").alias("hit_evidence"))


@_query(f"""WITH RECURSIVE {_EXACT}, {_PAIRS}, {_ROOTS}, named AS (SELECT h.id, coalesce(r.root, c.id) AS group_id FROM hashes h JOIN classes c ON h.phash IS NOT DISTINCT FROM c.phash AND h.dhash IS NOT DISTINCT FROM c.dhash AND h.whash IS NOT DISTINCT FROM c.whash AND h.colorhash IS NOT DISTINCT FROM c.colorhash LEFT JOIN roots r ON r.id = c.id),
big AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM named QUALIFY count(*) OVER (PARTITION BY group_id) > 1)
SELECT (SELECT count(DISTINCT group_id) FROM exact) AS total_exact_groups, (SELECT count(DISTINCT group_id) FROM big) AS total_perceptual_groups, (SELECT count(*) FROM exact) + (SELECT count(*) FROM big) AS total_duplicate_images, (SELECT count(*) FROM documents) AS total_images_checked""")
def duplicate_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return dedup.stats(dedup.exact_groups(docs, "doc_id", "text"), dedup.perceptual_groups(views.hashes(spark, sf_dir), RULE), docs)


# ---- feature statistics -----------------------------------------------------------------------------------------

_STATS = _FEATS + ", st AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS low, max(value) AS high FROM melted GROUP BY feature)"
_GROUP = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in FEATURE_GROUPS.items()) + " END"
_MEANS = _FEATS + ", cm AS (SELECT cluster_id, feature, count(*) AS n, avg(value) AS mean, var_pop(value) AS v, stddev_pop(value) AS std FROM melted GROUP BY ALL), gm AS (SELECT feature, avg(value) AS gmean, stddev_pop(value) AS gstd FROM melted GROUP BY feature), dev AS (SELECT cluster_id, feature, mean, abs(mean - gmean) / (gstd + 1e-8) AS deviation FROM cm JOIN gm USING (feature) WHERE cluster_id >= 0)"


@_query(f"{_STATS} SELECT feature, mean, std, iqr, variance, iqr < (SELECT quantile_cont(iqr, 0.1) FROM st) AS is_dead FROM st", "mean", "std", "iqr", "variance")
def feature_diagnostics(spark, sf_dir):
    return stats.diagnostics(views.features(spark, sf_dir), NAMES)


@_query(f'{_STATS}, g AS (SELECT {_GROUP} AS "group", greatest(avg(iqr), 1e-10) AS iqr FROM st GROUP BY 1) SELECT "group", round(least(greatest(iqr / avg(iqr) OVER (), 0.5), 2.0), 4) AS weight FROM g', "weight")
def iqr_weights(spark, sf_dir):
    return stats.iqr_weights(views.features(spark, sf_dir), FEATURE_GROUPS)


@_query(f"{_STATS} SELECT feature, iqr, row_number() OVER (ORDER BY round(iqr, 9) DESC, feature)::INTEGER AS rank FROM st", "iqr")
def feature_ranking(spark, sf_dir):
    rows = stats.column_stats(views.features(spark, sf_dir), NAMES)
    return rows.select("feature", "iqr", F.row_number().over(Window.orderBy(F.desc(F.round("iqr", 9)), "feature")).alias("rank"))


@_query(f"{_MEANS} SELECT cluster_id, feature, deviation, row_number() OVER (PARTITION BY cluster_id ORDER BY deviation DESC, feature)::INTEGER AS rank FROM dev QUALIFY rank <= 5", "deviation")
def feature_importance(spark, sf_dir):
    return stats.importance(views.features(spark, sf_dir), NAMES)


@_query(f"{_MEANS} SELECT cluster_id, round(avg(deviation), 4) AS distinctiveness, CASE WHEN avg(deviation) >= 1 THEN 'distinct' WHEN avg(deviation) >= 0.6 THEN 'moderate' ELSE 'weak' END AS quality FROM dev GROUP BY cluster_id", "distinctiveness")
def cluster_distinctiveness(spark, sf_dir):
    return stats.distinctiveness(views.features(spark, sf_dir), NAMES)


@_query(f"{_MEANS} SELECT cluster_id, n AS count, feature, mean, std FROM cm", "mean", "std")
def cluster_summary(spark, sf_dir):
    return stats.cluster_summary(views.features(spark, sf_dir), NAMES)


@_query(f"WITH feats AS ({FEATURES_SQL}) SELECT cluster_id, count(*) AS count, array_to_string(list_sort(list(vec_id))[1:3], ';') AS examples FROM feats GROUP BY cluster_id")
def cluster_preview(spark, sf_dir):
    return stats.cluster_preview(views.features(spark, sf_dir), "vec_id").select("cluster_id", "count", F.array_join(F.col("examples").cast("array<string>"), ";").alias("examples"))


_CORR = f"WITH feats AS ({FEATURES_SQL}), c AS (SELECT {', '.join(f'corr({a}, {b}) AS c{i}_{j}' for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if i < j)} FROM feats), corr AS (SELECT u.* FROM c, LATERAL (VALUES {', '.join(f'({a!r}, {b!r}, c{i}_{j})' for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if i < j)}) u(feature_a, feature_b, r))"


@_query(f"{_CORR} SELECT * FROM corr", "r")
def feature_correlations(spark, sf_dir):
    return stats.correlations(views.features(spark, sf_dir), NAMES)


@_query(f"{_CORR} SELECT * FROM corr WHERE abs(r) >= 0.1", "r")
def redundant_pairs(spark, sf_dir):
    return stats.redundant_pairs(views.features(spark, sf_dir), NAMES, 0.1)


_RANKS = f"{_MEANS}, ranks AS (SELECT c.cluster_id, c.feature, avg(CASE WHEN m.value < c.mean THEN 100.0::DOUBLE ELSE 0 END) AS percentile FROM cm c JOIN melted m USING (feature) WHERE c.cluster_id >= 0 GROUP BY ALL)"


@_query(f"{_RANKS} SELECT * FROM ranks", "percentile")
def cluster_percentiles(spark, sf_dir):
    return stats.percentile_ranks(views.features(spark, sf_dir), NAMES)


def _naming_sql() -> str:
    from tesserae.functions.config import TAG_RULES

    rows = ", ".join(f"({gi}, '{g}', {ti}, '{t}', '{f}', '{d}', {w}::DOUBLE)" for gi, (g, tags) in enumerate(TAG_RULES.items()) for ti, (t, parts) in enumerate(tags.items()) for f, d, w in parts)
    return f"""{_RANKS}, rules(g, grp, t, tag, feature, direction, w) AS (VALUES {rows}),
s AS (SELECT cluster_id, g, grp, t, tag, round(sum(greatest(0, CASE direction WHEN 'high' THEN (percentile - 50) / 50 WHEN 'low' THEN (50 - percentile) / 50 ELSE 1 - abs(percentile - 50) / 30 END) * w) / sum(w), 12) AS score FROM ranks JOIN rules USING (feature) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, g ORDER BY score DESC, t) AS n FROM s QUALIFY n = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, g) AS place FROM best WHERE score > 0.1 QUALIFY place <= 5),
named AS (SELECT cluster_id, array_to_string(list(tag ORDER BY place) FILTER (score > 0.15), '_') AS name, round(avg(round(least(score, 1), 4)) + {naming.TIE}, 4) AS conf FROM top GROUP BY cluster_id)
SELECT cluster_id, coalesce(nullif(name, ''), 'balanced') AS suggested_name, coalesce(conf, 0) AS name_confidence FROM (SELECT DISTINCT cluster_id FROM ranks) LEFT JOIN named USING (cluster_id)"""


@_query(_naming_sql(), "name_confidence")
def cluster_names(spark, sf_dir):
    ranks = stats.percentile_ranks(views.features(spark, sf_dir), NAMES)
    return naming.name_clusters(ranks).select("cluster_id", "suggested_name", "name_confidence")


_N = "(SELECT count(*) FROM feats)"
_BINS = f"least(50, {_N} // 10 + 1)"


@_query(f"{_STATS}, b AS (SELECT feature, least(floor((value - low) / (high - low) * {_BINS}), {_BINS} - 1) AS bin FROM melted JOIN st USING (feature)), p AS (SELECT feature, bin, count(*) / {_N}::DOUBLE AS p FROM b GROUP BY ALL) SELECT feature, -sum(p * ln(p + 1e-10)) AS entropy FROM p GROUP BY feature", "entropy")
def feature_entropy(spark, sf_dir):
    return stats.entropy(views.features(spark, sf_dir), NAMES)


@_query(f"{_MEANS}, a AS (SELECT feature, count(*) AS k, sum(n) AS nn, sum(n * v) AS within, sum(n * mean) AS s1, sum(n * mean * mean) AS s2 FROM cm WHERE cluster_id >= 0 GROUP BY feature) SELECT feature, ((s2 - s1 * s1 / nn) / (k - 1)) / (within / (nn - k)) AS anova_f FROM a", "anova_f")
def feature_anova(spark, sf_dir):
    return stats.anova(views.features(spark, sf_dir), NAMES)


@_query(f"""{_FEATS}, r AS (SELECT feature, cluster_id, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY feature, value) AS t, count(*) OVER (PARTITION BY feature) AS n FROM melted WHERE cluster_id >= 0),
s AS (SELECT feature, cluster_id, sum(rk) ** 2 / count(*) AS q FROM r GROUP BY ALL), c AS (SELECT feature, any_value(n)::DOUBLE AS n, sum(t::DOUBLE ** 2 - 1) AS tied FROM r GROUP BY feature)
SELECT feature, (12 / (n * (n + 1)) * sum(q) - 3 * (n + 1)) / (1 - tied / (n ** 3 - n)) AS kruskal_h FROM s JOIN c USING (feature) GROUP BY feature, n, tied""", "kruskal_h")
def feature_kruskal(spark, sf_dir):
    return stats.kruskal(views.features(spark, sf_dir), NAMES)


_S = ", ".join(f"({n} - median({n}) OVER ()) / (quantile_cont({n}, 0.75) OVER () - quantile_cont({n}, 0.25) OVER ()) AS {n}" for n in NAMES)


@_query(f"WITH feats AS ({FEATURES_SQL}) SELECT vec_id, cluster_id, {_S} FROM feats", *NAMES)
def robust_scaling(spark, sf_dir):
    return stats.robust_scale(views.features(spark, sf_dir), NAMES)


@_query(f"WITH feats AS ({FEATURES_SQL}) SELECT vec_id, cluster_id, {', '.join(f'({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () AS {n}' for n in NAMES)} FROM feats", *NAMES)
def standard_scaling(spark, sf_dir):
    return stats.standard_scale(views.features(spark, sf_dir), NAMES)


# ---- measures of a clustering -----------------------------------------------------------------------------------

_GAP = "sqrt(" + " + ".join(f"(x.{n} - y.{n}) ** 2" for n in NAMES) + ")"
_SIL = f"""WITH feats AS ({FEATURES_SQL}), d AS (SELECT x.vec_id, x.cluster_id AS own, y.cluster_id AS other, sum({_GAP}) AS total, count(*) AS n FROM feats x, feats y WHERE x.cluster_id >= 0 AND y.cluster_id >= 0 GROUP BY ALL),
s AS (SELECT vec_id, own, max(CASE WHEN own = other THEN total / (n - 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY ALL)"""


@_query(f"{_SIL} SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette_score FROM s", "silhouette_score")
def silhouette(spark, sf_dir):
    return metrics.silhouette(views.features(spark, sf_dir), NAMES, "vec_id")


_CENT = f"WITH feats AS ({FEATURES_SQL}), cent AS (SELECT cluster_id, count(*) AS n, {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM feats GROUP BY cluster_id), spread AS (SELECT x.cluster_id, avg({_GAP}) AS spread, any_value(y.n) AS n FROM feats x JOIN cent y USING (cluster_id) GROUP BY x.cluster_id)"


@_query(f"{_CENT}, r AS (SELECT x.cluster_id, max((sx.spread + sy.spread) / {_GAP}) AS r FROM cent x JOIN cent y ON x.cluster_id <> y.cluster_id JOIN spread sx ON sx.cluster_id = x.cluster_id JOIN spread sy ON sy.cluster_id = y.cluster_id GROUP BY x.cluster_id) SELECT round(avg(r), 4) AS davies_bouldin_score FROM r", "davies_bouldin_score")
def davies_bouldin(spark, sf_dir):
    return metrics.davies_bouldin(views.features(spark, sf_dir), NAMES)


@_query(f"{_CENT} SELECT round(avg(spread), 4) AS cohesion FROM spread WHERE cluster_id >= 0 AND n > 1", "cohesion")
def cohesion(spark, sf_dir):
    return metrics.cohesion(views.features(spark, sf_dir), NAMES)


@_query("WITH s AS (SELECT count(*) AS n FROM embeddings WHERE label < 9 GROUP BY label), p AS (SELECT n / sum(n) OVER ()::DOUBLE AS p, count(*) OVER () AS k FROM s) SELECT round(-sum(p * log2(p)) / log2(least(any_value(k), 10)), 4) AS label_entropy FROM p", "label_entropy")
def label_entropy(spark, sf_dir):
    return metrics.label_entropy(views.features(spark, sf_dir))


def _relabelled(spark, sf_dir):
    return views.features(spark, sf_dir).withColumn("new_id", F.when(F.col("vec_id") % 7 == 0, -1).when(F.col("vec_id") % 5 == 0, (F.col("cluster_id") + 1) % 9).otherwise(F.col("cluster_id")).cast("int"))


_RELABEL = "lab AS (SELECT vec_id, (CASE WHEN label = 9 THEN -1 ELSE label END)::INTEGER AS cluster_id, (CASE WHEN vec_id % 7 = 0 THEN -1 WHEN vec_id % 5 = 0 THEN ((CASE WHEN label = 9 THEN -1 ELSE label END) + 1) % 9 ELSE CASE WHEN label = 9 THEN -1 ELSE label END END)::INTEGER AS new_id FROM embeddings)"
_CHOOSE = lambda n: f"({n} * ({n} - 1) / 2)"


@_query(f"WITH {_RELABEL}, c AS (SELECT count(*)::DOUBLE AS n FROM lab GROUP BY cluster_id, new_id), a AS (SELECT sum({_CHOOSE('n')}) AS s FROM (SELECT count(*)::DOUBLE AS n FROM lab GROUP BY cluster_id)), b AS (SELECT sum({_CHOOSE('n')}) AS s FROM (SELECT count(*)::DOUBLE AS n FROM lab GROUP BY new_id)), t AS (SELECT sum({_CHOOSE('n')}) AS s, sum(n) AS n FROM c) SELECT (t.s - a.s * b.s / {_CHOOSE('t.n')}) / ((a.s + b.s) / 2 - a.s * b.s / {_CHOOSE('t.n')}) AS adjusted_rand_index FROM t, a, b", "adjusted_rand_index")
def adjusted_rand(spark, sf_dir):
    return metrics.rand_index(_relabelled(spark, sf_dir), "cluster_id", "new_id")


_SIZES = lambda c, p: f"{p} AS (SELECT count(*) FILTER (k >= 0) AS clusters, coalesce(sum(n) FILTER (k < 0), 0)::BIGINT AS noise, coalesce(max(n) FILTER (k >= 0), 0)::BIGINT AS largest, sum(n)::BIGINT AS total FROM (SELECT {c} AS k, count(*) AS n FROM lab GROUP BY {c}))"


@_query(f"WITH {_RELABEL}, {_SIZES('cluster_id', 'o')} SELECT total, clusters, noise, round(noise / total::DOUBLE, 4) AS noise_rate, round(largest / total::DOUBLE, 4) AS largest_ratio FROM o", "noise_rate", "largest_ratio")
def cluster_sizes(spark, sf_dir):
    return metrics.sizes(views.features(spark, sf_dir))


@_query(f"""WITH {_RELABEL}, {_SIZES('cluster_id', 'o')}, {_SIZES('new_id', 'n')} SELECT o.total AS total_images, (SELECT count(*) FROM lab WHERE cluster_id <> new_id) AS changed_cluster_count, round((SELECT avg((cluster_id <> new_id)::INTEGER::DOUBLE) FROM lab), 4) AS changed_cluster_ratio,
o.clusters AS old_cluster_count, o.noise AS old_noise_count, round(o.noise / o.total::DOUBLE, 4) AS old_noise_rate, round(o.largest / o.total::DOUBLE, 4) AS old_largest_cluster_ratio, n.clusters AS new_cluster_count, n.noise AS new_noise_count, round(n.noise / n.total::DOUBLE, 4) AS new_noise_rate, round(n.largest / n.total::DOUBLE, 4) AS new_largest_cluster_ratio FROM o, n""", "changed_cluster_ratio", "old_noise_rate", "old_largest_cluster_ratio", "new_noise_rate", "new_largest_cluster_ratio")
def recluster_diff(spark, sf_dir):
    return metrics.label_changes(_relabelled(spark, sf_dir), "vec_id", "cluster_id", "new_id")[0]


@_query(f"WITH {_RELABEL} SELECT vec_id, cluster_id AS old_cluster, new_id AS new_cluster FROM lab WHERE cluster_id <> new_id ORDER BY vec_id LIMIT 100")
def recluster_changes(spark, sf_dir):
    return metrics.label_changes(_relabelled(spark, sf_dir), "vec_id", "cluster_id", "new_id")[1]


_RUNS = "SELECT p_partkey AS run, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C1' END AS mode, (p_partkey % 41) / 100.0::DOUBLE AS noise_rate, (p_partkey % 61) / 100.0::DOUBLE AS largest_cluster_ratio, (p_partkey % 17) / 20.0::DOUBLE - 0.2 AS silhouette, (p_partkey % 23) / 100.0::DOUBLE AS histogram_cohesion, (p_partkey % 29) / 100.0::DOUBLE AS quality_cohesion, (p_partkey % 11) / 10.0::DOUBLE AS label_entropy, (p_partkey % 47) / 100.0::DOUBLE AS changed_image_ratio FROM part"


@_query(f"""WITH runs AS ({_RUNS}), e AS (SELECT *, noise_rate > 0.35 OR largest_cluster_ratio > 0.55 OR (starts_with(mode, 'C') AND changed_image_ratio > 0.40) AS eliminated FROM runs)
SELECT run, eliminated, CASE WHEN eliminated THEN 0 ELSE round(greatest(0, 0.30 * greatest(0, least(1, silhouette + 0.5)) + 0.25 * greatest(0, least(1, 1 - histogram_cohesion * 5)) + 0.15 * greatest(0, least(1, 1 - quality_cohesion * 3)) + 0.15 * label_entropy - 0.10 * greatest(0, (noise_rate - 0.15) * 2) - 0.10 * greatest(0, (largest_cluster_ratio - 0.30) * 2)), 4) END AS score FROM e""", "score")
def experiment_scores(spark, sf_dir):
    k = F.col("p_partkey")
    part = lambda n, by: k % n / by
    runs = table(spark, sf_dir, "part").select(k.alias("run"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C1").alias("mode"), part(41, 100).alias("noise_rate"), part(61, 100).alias("largest_cluster_ratio"), (part(17, 20) - 0.2).alias("silhouette"), part(23, 100).alias("histogram_cohesion"), part(29, 100).alias("quality_cohesion"), part(11, 10).alias("label_entropy"), part(47, 100).alias("changed_image_ratio"))
    return metrics.experiment_scores(runs).select("run", "eliminated", "score")


_TRIALS = "runs AS (SELECT 'r' || s_suppkey % 6 AS recipe, 'd' || s_nationkey % 5 AS dataset, (s_suppkey % 37) / 40.0::DOUBLE AS silhouette, (s_suppkey % 31)::DOUBLE AS noise_rate, s_suppkey % 13 AS n_clusters, (s_suppkey % 19) / 20.0::DOUBLE AS largest_cluster_ratio FROM supplier)"


def _trials(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), k % 6).alias("recipe"), F.concat(F.lit("d"), F.col("s_nationkey") % 5).alias("dataset"), (k % 37 / 40).alias("silhouette"), (k % 31).cast("double").alias("noise_rate"), (k % 13).alias("n_clusters"), (k % 19 / 20).alias("largest_cluster_ratio"))


@_query(f"""WITH {_TRIALS}, b(dataset, b_sil, b_noise, b_clusters) AS (VALUES ('d0', 0.469::DOUBLE, 21.7::DOUBLE, 4), ('d1', 0.458::DOUBLE, 20.1::DOUBLE, 10)),
s AS (SELECT recipe, greatest(0, CASE WHEN b_sil IS NOT NULL THEN greatest(0, 100 - greatest(0, b_sil - silhouette) * 200) - least(30, greatest(0, (noise_rate - b_noise) * 2)) - least(20, abs(n_clusters - b_clusters) * 5) ELSE least(100, silhouette * 150) - least(30, noise_rate * 1.5) - CASE WHEN largest_cluster_ratio > 0.5 THEN 20 ELSE 0 END END) AS s,
silhouette - b_sil AS sil, abs(noise_rate - b_noise) AS noise, abs(n_clusters - b_clusters) AS c FROM runs LEFT JOIN b USING (dataset))
SELECT recipe, round(avg(s), 1) AS avg_composite_score, round(avg(sil), 4) AS avg_silhouette_delta, round(avg(noise), 2) AS avg_noise_rate_abs_delta, round(avg(c), 1) AS avg_cluster_count_abs_delta, count(sil) AS datasets_with_baseline FROM s GROUP BY recipe""", "avg_composite_score", "avg_silhouette_delta", "avg_noise_rate_abs_delta", "avg_cluster_count_abs_delta")
def recipe_scores(spark, sf_dir):
    base = spark.createDataFrame([("d0", 0.469, 21.7, 4), ("d1", 0.458, 20.1, 10)], "dataset string, silhouette double, noise_rate double, clusters int")
    return experiments.recipe_scores(_trials(spark, sf_dir), base)


@_query(f"WITH {_TRIALS} SELECT recipe AS trial, 0.7 * coalesce(avg(silhouette) FILTER (dataset IN ('d0', 'd1')), 0) + 0.3 * coalesce(avg(silhouette) FILTER (dataset NOT IN ('d0', 'd1')), 0) AS objective FROM runs GROUP BY recipe", "objective")
def tuning_objective(spark, sf_dir):
    return experiments.objective(_trials(spark, sf_dir).select(F.col("recipe").alias("trial"), F.col("silhouette").alias("score"), F.col("dataset").isin("d0", "d1").alias("is_baseline")))


@_query(f"WITH {_TRIALS}, g AS (SELECT dataset, avg(silhouette) AS m, stddev_pop(silhouette) AS s, min(silhouette) AS lo, max(silhouette) AS hi, max(n_clusters) - min(n_clusters) AS cluster_range, max(largest_cluster_ratio) - min(largest_cluster_ratio) AS largest_range FROM runs GROUP BY dataset) SELECT dataset, m AS mean_silhouette, s AS std_silhouette, hi - lo AS silhouette_range, cluster_range, largest_range, greatest(hi - m, m - lo) AS max_deviation, greatest(hi - m, m - lo) < 0.02 AS stable FROM g", "mean_silhouette", "std_silhouette", "silhouette_range", "largest_range", "max_deviation")
def repeat_stability(spark, sf_dir):
    return experiments.repeat_stats(_trials(spark, sf_dir))


@_query()
def density_clusters(spark, sf_dir):
    scaled = stats.robust_scale(views.features(spark, sf_dir), NAMES)
    return cluster.density_clusters(scaled, NAMES, "vec_id").select("vec_id", "cluster_id")


@_query()
def principal_components(spark, sf_dir):
    return cluster.embedding(stats.robust_scale(views.features(spark, sf_dir), NAMES), NAMES, "vec_id", 3)


@_query()
def refined_clusters(spark, sf_dir):
    return cluster.refine(views.features(spark, sf_dir), NAMES, "vec_id").select("vec_id", "cluster_id", "sub", "accepted")


@_query()
def feature_information(spark, sf_dir):
    return cluster.information(views.features(spark, sf_dir), NAMES)


def _localized_sql() -> str:
    tags = sorted(experiments.TAG_NAMES, key=lambda t: (-len(t), list(experiments.TAG_NAMES).index(t)))
    wide = lambda t: t.replace("_", "__")  # noqa: E731  # every match has separators of its own
    pairs = ", ".join(f"{{'t': '{wide(t)}', 'w': '{experiments.TAG_NAMES[t]}'}}" for t in tags)
    found = f"regexp_extract_all('_' || replace(suggested_name, '_', '__') || '_', '_({'|'.join(map(wide, tags))})_', 1)"
    shown = f"array_to_string(list_transform(list_filter([{pairs}], lambda x: list_contains({found}, x.t))[1:4], lambda x: x.w), ' · ')"
    return f"""SELECT cluster_id, suggested_name, CASE WHEN lower(suggested_name) = 'noise' THEN '未归类' WHEN shown = '' THEN replace(suggested_name, '_', ' ') ELSE shown END AS display_name
FROM (SELECT cluster_id, suggested_name, {shown} AS shown FROM ({_naming_sql()}))"""


@_query(_localized_sql())
def localized_names(spark, sf_dir):
    ranks = stats.percentile_ranks(views.features(spark, sf_dir), NAMES)
    named = naming.name_clusters(ranks)
    return named.select("cluster_id", "suggested_name", experiments.localized(F.col("suggested_name")).alias("display_name"))


_HEALTH = f"""{_MEANS}, d AS (SELECT x.vec_id, x.cluster_id AS own, y.cluster_id AS other, sum({_GAP}) AS total, count(*) AS n FROM feats x, feats y GROUP BY ALL),
s AS (SELECT vec_id, own, max(CASE WHEN own = other THEN total / (n - 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY ALL),
sil AS (SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM s), m AS (SELECT avg(v) AS mean FROM (SELECT round(avg(deviation), 4) AS v FROM dev GROUP BY cluster_id)),
sized AS (SELECT cluster_id, count(*) AS n, count(*) / (SELECT count(*) FROM feats)::DOUBLE AS ratio FROM feats WHERE cluster_id >= 0 GROUP BY cluster_id),
shape AS (SELECT max(ratio) AS largest, count(*) AS k, 1 - sum(n) / (SELECT count(*) FROM feats)::DOUBLE AS noise, list_sort(list(cluster_id) FILTER (ratio < 0.01)) AS micro, list_sort(list(cluster_id) FILTER (ratio > 0.5)) AS dominant FROM sized),
h AS (SELECT silhouette, round(noise, 4) AS noise_ratio, round(mean, 4) AS mean_distinctiveness, coalesce(array_to_string(micro, ';'), '') AS micro_clusters, coalesce(array_to_string(dominant, ';'), '') AS dominant_clusters,
round(0.25::DOUBLE * greatest(silhouette, 0) + 0.25::DOUBLE * (CASE WHEN k <= 1 THEN 0.5 ELSE least(1 - (largest - 1 / k::DOUBLE), 0.5) * 2 END) + 0.25::DOUBLE * (1 - noise) + 0.25::DOUBLE * least(mean / 2, 1), 4) AS health_score FROM sil, m, shape)"""


@_query(f"{_HEALTH} SELECT *, CASE WHEN health_score >= 0.7 THEN 'healthy' WHEN health_score >= 0.4 THEN 'moderate' ELSE 'unhealthy' END AS health_level FROM h", "silhouette", "noise_ratio", "mean_distinctiveness", "health_score")
def cluster_health(spark, sf_dir):
    row = metrics.health(views.features(spark, sf_dir), NAMES, "vec_id")
    return row.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ";") for c in ("micro_clusters", "dominant_clusters")})


# ---- overlays ---------------------------------------------------------------------------------------------------

_ROWS = "atlas AS (SELECT 'o/' || (o_orderkey % 10) || '/' || o_orderkey || '.png' AS image_path, o_orderkey || '.png' AS filename, (o_custkey % 25 - 1)::INTEGER AS cluster_id, o_orderkey FROM orders)"
_MOVES = "moves AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'o/' || (o_orderkey % 10) || '/' || o_orderkey || '.png' ELSE o_orderkey || '.png' END AS alias, (o_orderkey % 30 - 1)::INTEGER AS target FROM orders WHERE o_orderstatus = 'F')"
_NAMES = "cat AS (SELECT n_nationkey - 1 AS cluster_id, n_name AS display_name FROM nation)"
_LABEL = lambda c, n: f"coalesce({n}.display_name, CASE WHEN {c} = -1 THEN 'noise' ELSE 'Cluster ' || {c} END)"
_MOVED = f"WITH {_ROWS}, {_MOVES}, {_NAMES}, moved AS (SELECT a.image_path, a.filename, a.cluster_id AS original_cluster_id, coalesce(m1.target, m2.target, a.cluster_id) AS cluster_id FROM atlas a LEFT JOIN moves m1 ON m1.alias = a.image_path LEFT JOIN moves m2 ON m2.alias = a.filename)"


def _atlas(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("o/"), F.col("o_orderkey") % 10, F.lit("/"), F.col("o_orderkey"), F.lit(".png")).alias("image_path"), F.concat("o_orderkey", F.lit(".png")).alias("filename"), (F.col("o_custkey") % 25 - 1).cast("int").alias("cluster_id"))


def _moved(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    name = F.concat("o_orderkey", F.lit(".png"))
    moves = o.select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("o/"), F.col("o_orderkey") % 10, F.lit("/"), name)).otherwise(name).alias("alias"), (F.col("o_orderkey") % 30 - 1).cast("int").alias("target"))
    return overlay.apply_moves(_atlas(spark, sf_dir), moves)


def _cat(spark, sf_dir):
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") - 1).alias("cluster_id"), F.col("n_name").alias("display_name"))


@_query(f"{_MOVED} SELECT image_path, filename, m.cluster_id, original_cluster_id, {_LABEL('m.cluster_id', 'c')} AS cluster_name, {_LABEL('original_cluster_id', 'd')} AS original_cluster_name FROM moved m LEFT JOIN cat c ON c.cluster_id = m.cluster_id LEFT JOIN cat d ON d.cluster_id = m.original_cluster_id")
def overlay_moves(spark, sf_dir):
    return overlay.with_names(_moved(spark, sf_dir), _cat(spark, sf_dir))


@_query(f"{_MOVED}, n AS (SELECT cluster_id, count(*) AS n FROM moved GROUP BY cluster_id) SELECT coalesce(n.cluster_id, c.cluster_id) AS cluster_id, {_LABEL('coalesce(n.cluster_id, c.cluster_id)', 'c')} AS display_name, coalesce(n, 0) AS count, abs(coalesce(n.cluster_id, c.cluster_id)) % 8 AS color FROM n FULL JOIN cat c ON c.cluster_id = n.cluster_id")
def cluster_counts(spark, sf_dir):
    return overlay.cluster_counts(_moved(spark, sf_dir), _cat(spark, sf_dir))


@_query("""WITH a AS (SELECT r_regionkey AS cluster_id, r_name AS name FROM region), n AS (SELECT n_nationkey % 7 AS cluster_id, max(n_name) AS name FROM nation WHERE n_nationkey > 3 GROUP BY 1), s AS (SELECT s_nationkey % 9 - 1 AS cluster_id, count(*) AS n FROM supplier GROUP BY 1)
SELECT cluster_id, coalesce(CASE WHEN cluster_id % 4 = 0 THEN 'renamed ' || cluster_id END, a.name, n.name, CASE WHEN cluster_id = -1 THEN 'noise' ELSE 'Cluster ' || cluster_id END) AS display_name, coalesce(n.name, a.name, CASE WHEN cluster_id = -1 THEN 'noise' ELSE 'Cluster ' || cluster_id END) AS suggested_name, CASE WHEN a.name IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END AS confidence, coalesce(s.n, 0) AS count FROM a FULL JOIN n USING (cluster_id) FULL JOIN s USING (cluster_id)""", "confidence")
def cluster_catalogue(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    analysis = region.select(F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("suggested_name"), F.lit(0.5).alias("confidence"))
    names = nation.where("n_nationkey > 3").groupBy((F.col("n_nationkey") % 7).alias("cluster_id")).agg(F.max("n_name").alias("name"))
    summary = supplier.groupBy((F.col("s_nationkey") % 9 - 1).alias("cluster_id")).agg(F.count("*").alias("count")).withColumn("name", F.lit(None).cast("string"))
    report = summary.where("false")
    known = analysis.select("cluster_id").union(names.select("cluster_id")).union(summary.select("cluster_id")).distinct()
    renames = known.where("cluster_id % 4 = 0").select("cluster_id", F.concat(F.lit("renamed "), F.col("cluster_id")).alias("display_name"))
    return overlay.catalogue(analysis, names, summary, report, renames)


_LOG = "log AS (SELECT user_id AS image, CASE WHEN event_type IN ('click', 'view') THEN 'keep' WHEN event_type = 'purchase' THEN 'nonsense' END AS flag, CASE WHEN event_id % 3 = 0 THEN event_type END AS note, CASE WHEN event_id % 2 = 0 THEN event_id % 9 - 2 END AS rating, event_id AS seq FROM events)"


@_query(f"WITH {_LOG}, m AS (SELECT image, arg_max(flag, seq) FILTER (flag IS NOT NULL) AS flag, arg_max(note, seq) FILTER (note IS NOT NULL) AS note, arg_max(rating, seq) FILTER (rating IS NOT NULL) AS rating FROM log GROUP BY image) SELECT image, CASE WHEN flag IN ('keep', 'pick', 'reject', 'review', 'favorite') THEN flag END AS flag, note, CASE WHEN rating IS NULL THEN 5 ELSE least(greatest(rating, 0), 5) END AS rating FROM m")
def review_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t, i = F.col("event_type"), F.col("event_id")
    log = e.select(F.col("user_id").alias("image"), F.when(t.isin("click", "view"), "keep").when(t == "purchase", "nonsense").alias("flag"), F.when(i % 3 == 0, t).alias("note"), F.when(i % 2 == 0, i % 9 - 2).alias("rating"), i.alias("seq"))
    return overlay.reviews(log).withColumn("rating", F.coalesce("rating", F.lit(5).cast("long")))


@_query(f"WITH {_ROWS} SELECT image_path, filename, cluster_id FROM atlas WHERE filename IN (SELECT doc_id || '.png' FROM labels WHERE quality = 1)")
def reviewed_rows(spark, sf_dir):
    reviews = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat("doc_id", F.lit(".png")).alias("image"), F.lit("keep").alias("flag"))
    return overlay.reviewed(_atlas(spark, sf_dir), reviews, "keep")


@_query("SELECT c_custkey AS image_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'a/' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'b/' || c_custkey END) AS path FROM customer")
def resolved_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"))
    source = lambda n, p: ids.where(f"image_id % {n} = 0").select("image_id", F.concat(F.lit(p), F.col("image_id")).alias("path"))
    return overlay.resolve(ids, [source(2, "a/"), source(3, "b/")])


# ---- lists of ids -----------------------------------------------------------------------------------------------

_LISTS = "lists AS (SELECT l_returnflag AS list_id, l_orderkey AS image_id, min(l_partkey) AS rank FROM lineitem GROUP BY 1, 2)"


def _lists(spark, sf_dir):
    """Three lists, one for each return flag."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("list_id"), F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("rank"))


@_query(f"WITH {_LISTS} SELECT image_id, avg(rank) AS order_value FROM lists GROUP BY image_id HAVING count(*) = 3", "order_value")
def slice_intersection(spark, sf_dir):
    return slices.intersect_all(_lists(spark, sf_dir), 3)


@_query(f"WITH {_LISTS} SELECT image_id, min(rank) FILTER (list_id = 'N')::DOUBLE AS order_value FROM lists GROUP BY image_id HAVING count(*) = 3", "order_value")
def slice_intersection_primary(spark, sf_dir):
    return slices.intersect_all(_lists(spark, sf_dir), 3, "primary", "N").withColumn("order_value", F.col("order_value").cast("double"))


@_query(f"WITH {_LISTS} SELECT image_id, rank FROM lists a WHERE list_id = 'A' AND EXISTS (SELECT 1 FROM lists b WHERE b.list_id = 'N' AND b.image_id = a.image_id) AND EXISTS (SELECT 1 FROM lists b WHERE b.list_id = 'R' AND b.image_id = a.image_id) ORDER BY rank, image_id LIMIT 50")
def slice_combination(spark, sf_dir):
    one = lambda k: _lists(spark, sf_dir).where(F.col("list_id") == k).groupBy("image_id").agg(F.min("rank").alias("rank"))
    return slices.combine(one("A"), [one("N"), one("R")], 50)


@_query("WITH a AS (SELECT DISTINCT o_custkey AS image_id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS image_id FROM orders WHERE o_orderstatus = 'O') (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def selection_toggle(spark, sf_dir):
    pick = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("image_id"))
    return slices.toggle(pick("F"), pick("O"))


@_query("WITH c AS (SELECT o_custkey AS item, list(o_orderkey % 500 ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1), r AS (SELECT item, unnest(ids[1:5]) AS image_id, unnest(range(len(ids[1:5])))::INTEGER AS pos FROM c) SELECT item, pos, image_id FROM r QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY item, pos) = 1")
def cart_flatten(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x % 500)
    cart = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item")).agg(ids.alias("image_ids")).withColumn("top_n", F.lit(5))
    return slices.flatten_cart(cart)


@_query(f"WITH {_ROWS}, o AS (SELECT cluster_id, filename, row_number() OVER (PARTITION BY cluster_id ORDER BY o_orderkey DESC) - 1 AS position FROM atlas QUALIFY position < 3) SELECT a.cluster_id, a.filename, image_path, coalesce(o.position, 999)::INTEGER AS position FROM atlas a LEFT JOIN o USING (cluster_id, filename)")
def manual_order(spark, sf_dir):
    rows = _atlas(spark, sf_dir)
    key = F.split("filename", "[.]")[0].cast("long")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy(key.desc()))).where("n <= 3")
    orders = first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "filename"))), lambda x: x["filename"]).alias("files"))
    return slices.manual_order(rows, orders)


@_query(f"WITH feats AS ({FEATURES_SQL}) SELECT vec_id, contrast AS umap_x, saturation_mean AS umap_y FROM feats WHERE contrast BETWEEN -0.05 AND 0.05 AND saturation_mean BETWEEN 0 AND 0.1", "umap_x", "umap_y")
def viewport(spark, sf_dir):
    points = views.features(spark, sf_dir).select("vec_id", F.col("contrast").alias("umap_x"), F.col("saturation_mean").alias("umap_y"))
    return slices.viewport(points, -0.05, 0.05, 0.0, 0.1)


# ---- exports, inventory, scalars --------------------------------------------------------------------------------


@_query(f"WITH {_ROWS}, r AS (SELECT o_orderkey AS image_id, image_path AS path, row_number() OVER (ORDER BY o_orderkey) AS rank FROM atlas ORDER BY o_orderkey LIMIT 200) SELECT rank::INTEGER AS rank, image_id, path, 'picks/picks_' || lpad(rank::VARCHAR, 4, '0') || '.png' AS target FROM r")
def export_plan(spark, sf_dir):
    items = _atlas(spark, sf_dir).select(F.split("filename", "[.]")[0].cast("long").alias("image_id"), F.col("image_path").alias("path")).withColumn("position", F.col("image_id"))
    return export.plan(items, "picks", "{folder}_{index:04d}{ext}", 200)


@_query("""WITH r AS (SELECT o_orderkey AS image_id, 'd' || o_orderkey % 3 || '/' || o_orderkey % 50 || '.jpg' AS path, (o_custkey % 6 - 1)::INTEGER AS c FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY image_id) AS rank, CASE WHEN c < 0 THEN 'noise' ELSE 'cluster_' || lpad(c::VARCHAR, 3, '0') END || '_name_' || c AS folder, image_id % 50 AS f FROM r)
SELECT rank::INTEGER AS rank, image_id, path, folder || '/' || f || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || (row_number() OVER w - 1) END || '.jpg' AS target FROM k WINDOW w AS (PARTITION BY folder, f ORDER BY rank, image_id)""")
def export_by_cluster(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    c = (F.col("o_custkey") % 6 - 1).cast("int")
    rows = o.select(k.alias("image_id"), F.concat(F.lit("d"), k % 3, F.lit("/"), k % 50, F.lit(".jpg")).alias("path"), c.alias("cluster_id"), F.concat(F.lit("name "), c).alias("cluster_name"), k.alias("position"))
    return export.by_cluster(rows)


_FILES = "files AS (SELECT 'f/' || doc_id AS path, source AS root_name, lang AS leaf_dir, CASE WHEN doc_id % 4 = 0 THEN '.png' ELSE '.jpg' END AS extension, (doc_id % 23 * 100)::INTEGER AS width, (doc_id % 17 * 100 + 100)::INTEGER AS height, doc_id * 60000 AS size_bytes FROM documents)"


def _files(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("f/"), d).alias("path"), F.col("source").alias("root_name"), F.col("lang").alias("leaf_dir"), F.when(d % 4 == 0, ".png").otherwise(".jpg").alias("extension"), (d % 23 * 100).cast("int").alias("width"), (d % 17 * 100 + 100).cast("int").alias("height"), (d * 60000).alias("size_bytes"))


_INV = f"""WITH {_FILES}, inv AS (SELECT *, size_bytes / (1024 * 1024)::DOUBLE AS file_size_mb, width > 0 AS readable, CASE WHEN size_bytes / 1048576.0 > 200 THEN 'too_large' WHEN width <= 0 THEN 'broken' ELSE '' END AS skip_reason,
CASE WHEN width <= 0 OR height <= 0 THEN 'unknown' WHEN width / height::DOUBLE > 2 THEN 'wide' WHEN width / height::DOUBLE > 1.1 THEN 'landscape' WHEN width / height::DOUBLE < 0.9 THEN 'portrait' ELSE 'square' END AS orientation,
CASE WHEN greatest(width, height) <= 512 THEN 'small' WHEN greatest(width, height) <= 1920 THEN 'medium' WHEN greatest(width, height) <= 4096 THEN 'large' ELSE 'huge' END AS size_bucket,
CASE WHEN size_bytes / 1048576.0 < 0.1 THEN 'tiny' WHEN size_bytes / 1048576.0 < 5 THEN 'normal' WHEN size_bytes / 1048576.0 < 50 THEN 'large' ELSE 'huge' END AS file_size_bucket, substr(sha256(path), 1, 8) AS path_hash FROM files)"""


@_query(f"{_INV} SELECT * FROM inv", "file_size_mb")
def inventory(spark, sf_dir):
    return sampling.inventory(_files(spark, sf_dir))


@_query(f"{_INV} SELECT root_name, CASE WHEN NOT readable THEN 'broken' WHEN skip_reason = 'too_large' THEN 'too_large' WHEN file_size_mb > 50 THEN 'stress' ELSE 'healthy' END AS part, count(*) AS n FROM inv GROUP BY ALL")
def inventory_parts(spark, sf_dir):
    return sampling.split(sampling.inventory(_files(spark, sf_dir))).groupBy("root_name", "part").agg(F.count("*").alias("n"))


@_query(f"""{_INV}, h AS (SELECT *, md5('42:' || path) AS h FROM inv WHERE readable AND skip_reason = '' AND file_size_mb <= 50), a AS (SELECT *, row_number() OVER (PARTITION BY root_name, leaf_dir ORDER BY h, path) AS n FROM h),
l AS (SELECT root_name, leaf_dir, list(DISTINCT orientation) AS os, list(DISTINCT extension) AS es FROM a WHERE n <= 2 GROUP BY ALL),
s AS (SELECT a.*, CASE WHEN n <= 2 THEN 100 ELSE CASE WHEN list_contains(os, orientation) THEN 0 ELSE 10 END + CASE WHEN list_contains(es, extension) THEN 0 ELSE 5 END END AS score FROM a JOIN l USING (root_name, leaf_dir)),
m AS (SELECT *, row_number() OVER (PARTITION BY root_name, leaf_dir ORDER BY score DESC, n) AS m FROM s QUALIFY m <= 5), r AS (SELECT *, row_number() OVER (PARTITION BY root_name ORDER BY (n > 2)::INTEGER, h, path) AS r, count(*) OVER (PARTITION BY root_name) AS size FROM m QUALIFY r <= 12)
SELECT path, root_name, leaf_dir, CASE WHEN n <= 2 THEN 'leaf_minimum' WHEN size > 12 THEN 'random_fill' ELSE 'orientation_extension_balance' END AS sample_reason FROM r ORDER BY (n > 2)::INTEGER, h, path LIMIT 150""")
def stratified_sample(spark, sf_dir):
    quota = sampling.Quota(max_total=150, max_per_root=12, max_per_leaf=5)
    return sampling.stratified(sampling.inventory(_files(spark, sf_dir)), quota).select("path", "root_name", "leaf_dir", "sample_reason")


@_query("SELECT url, replace(replace(rtrim(base64(encode(url)), '='), '+', '-'), '/', '_') AS image_id FROM pages")
def image_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", scalars.image_id(F.col("url")).alias("image_id"))


@_query("SELECT url, url AS path FROM pages")
def image_id_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", scalars.image_path(scalars.image_id(F.col("url"))).alias("path"))


@_query(f"WITH {HASHES_CTE} SELECT id, coalesce(bit_count(xor(phash, dhash)), 999)::INTEGER AS distance FROM hashes")
def hamming_distance(spark, sf_dir):
    return views.hashes(spark, sf_dir).select("id", scalars.hamming(F.col("phash"), F.col("dhash")).alias("distance"))


@_query("SELECT p_partkey, coalesce(CAST(TRY_CAST(CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.0' WHEN 2 THEN p_brand ELSE NULL END AS DOUBLE) AS INTEGER), -1) AS cluster_id FROM part")
def parsed_cluster_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 4 == 0, s).when(k % 4 == 1, F.concat(s, F.lit(".0"))).when(k % 4 == 2, F.col("p_brand"))
    return p.select("p_partkey", scalars.cluster_id(raw).alias("cluster_id"))


@_query("SELECT p_name, substr(trim(regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[<>:\"/\\\\|?*\\s]+', '_', 'g'), '_+', '_', 'g'), '_. '), 1, 120) AS filename FROM part")
def sanitized_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", scalars.sanitize_filename(F.concat("p_name", F.lit(" / "), "p_type")).alias("filename"))


@_query("SELECT source, sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT)::DECIMAL(38, 0)::VARCHAR || '-' || count(*) AS checksum FROM documents GROUP BY source")
def source_checksums(spark, sf_dir):
    return stats.checksums(table(spark, sf_dir, "documents"), "source", F.col("doc_id").cast("string"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.5 THEN 'fake_shadow' WHEN l_tax < 0.01 THEN 'cast_shadow' ELSE 'form_shadow' END AS label, CASE WHEN l_quantity * 4 < 60 THEN 'review_blurry' ELSE 'ok' END AS blur FROM lineitem")
def shadow_and_blur_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", labels.depth_consistency(F.col("l_tax"), F.col("l_discount") * 10).alias("label"), labels.blur_level(F.col("l_quantity") * 4).alias("blur"))


@_query("""WITH g AS (SELECT o_orderkey AS id, o_custkey AS group_id, CASE WHEN o_custkey % 3 = 0 THEN 'exact' ELSE 'perceptual' END AS group_type FROM orders),
log AS (SELECT l_suppkey AS group_id, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS action, CASE WHEN l_linenumber % 3 = 0 THEN 'note ' || l_linenumber END AS note, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
r AS (SELECT group_id, arg_max(action, seq) FILTER (action IS NOT NULL) AS action, arg_max(note, seq) FILTER (note IS NOT NULL) AS note FROM log GROUP BY group_id)
SELECT id, g.group_id, group_type, action, note FROM g LEFT JOIN r USING (group_id) WHERE group_type = 'exact'""")
def duplicate_reviews(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    groups = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"), F.when(F.col("o_custkey") % 3 == 0, "exact").otherwise("perceptual").alias("group_type"))
    n = F.col("l_linenumber")
    log = items.select(F.col("l_suppkey").alias("group_id"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("action"), F.when(n % 3 == 0, F.concat(F.lit("note "), n)).alias("note"), (F.col("l_orderkey") * 10 + n).alias("seq"))
    return dedup.with_reviews(groups, dedup.reviews(log), "exact")


_ACCEPTED = ("p_retailprice", "p_size")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS count, min({c})::DOUBLE AS min, quantile_cont({c}, 0.05)::DOUBLE AS p05, avg({c}) AS mean, quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.95)::DOUBLE AS p95, max({c})::DOUBLE AS max, stddev_samp({c}) AS std FROM part" for c in _ACCEPTED), "min", "p05", "mean", "median", "p95", "max", "std")
def acceptance_statistics(spark, sf_dir):
    return stats.acceptance(table(spark, sf_dir, "part"), _ACCEPTED)


@_query("SELECT doc_id, 'data/' || source || '/' || CASE WHEN doc_id % 5 = 0 THEN '../../etc/' WHEN doc_id % 5 = 1 THEN './x/../' WHEN doc_id % 5 = 2 THEN '../src1/' ELSE '' END || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN false WHEN 2 THEN true ELSE source IN ('src0', 'src1') END AS inside FROM documents")
def contained_paths(spark, sf_dir):
    k = F.col("doc_id") % 5
    middle = F.when(k == 0, "../../etc/").when(k == 1, "./x/../").when(k == 2, "../src1/").otherwise("")
    path = F.concat(F.lit("data/"), "source", F.lit("/"), middle, F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), export.contained(path, ["data/src0", "data/src1/"]).alias("inside"))


# ---- calibration in one scan ------------------------------------------------------------------------------------

_CONFIGS = (LabelConfig(), SHIFTED, LabelConfig(warm_ratio=0.35, cool_ratio=0.35, high_contrast_dark_ratio=0.2, high_contrast_bright_ratio=0.2))


def _config_rates_sql() -> str:
    none = " OR ".join(f"x_{k}" for k in RULES if k != "lineart_like_candidate")
    hits = ", ".join(f"('{k}', x_{k})" for k in RULES) + f", ('unclassified', NOT ({none})), ('warm_and_cool', x_warm AND x_cool)"
    one = [f"SELECT {k} AS config, source, u.label, avg(u.hit::INTEGER::DOUBLE) AS rate FROM (SELECT source, {_masks_sql(c, 'x_')} FROM masks), LATERAL (VALUES {hits}) u(label, hit) GROUP BY GROUPING SETS ((source, u.label), (u.label))" for k, c in enumerate(_CONFIGS)]
    return f"WITH {_summary_sql()} " + " UNION ALL ".join(one)


@_query(_config_rates_sql(), "rate")
def config_rates(spark, sf_dir):
    return calibrate.config_rates(_measured(spark, sf_dir), _CONFIGS, "source")


def _coarse_sql() -> str:
    start, targets = LabelConfig(), TARGET_RANGES["default"]
    fields = ", ".join(f"('{n}', {f})" for _, n, f, _ in SINGLE_RULES)
    rules = ", ".join(f"('{n}', {getattr(start, n)}, {op == '>'}, {targets.get(k, (0.05, 0.30))[0]}, {targets.get(k, (0.05, 0.30))[1]})" for k, n, _, op in SINGLE_RULES)
    return f"""WITH {_summary_sql()}, f AS (SELECT u.name, u.v FROM summary, LATERAL (VALUES {fields}) u(name, v)),
rules(name, t, above, low, high) AS (VALUES {rules}),
rates AS (SELECT name, any_value(t)::DOUBLE AS t, any_value(above) AS above, any_value(low)::DOUBLE AS low, any_value(high)::DOUBLE AS high, avg(coalesce(CASE WHEN above THEN v > t ELSE v < t END, false)::INTEGER::DOUBLE) AS rate, count(v) AS known, count(*) AS n FROM f JOIN rules USING (name) GROUP BY name),
shares AS (SELECT *, least(1.0, (CASE WHEN rate < low THEN low ELSE high END) * n / known) AS share FROM rates),
places AS (SELECT *, (CASE WHEN above THEN 1 - share ELSE share END) * (known - 1) AS pos FROM shares),
ordered AS (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS k FROM f WHERE v IS NOT NULL),
moved AS (SELECT p.name, CASE WHEN floor(pos) = ceil(pos) THEN a.v ELSE (ceil(pos) - pos) * a.v + (pos - floor(pos)) * b.v END AS v FROM places p JOIN ordered a ON a.name = p.name AND a.k = floor(pos) JOIN ordered b ON b.name = p.name AND b.k = ceil(pos))
SELECT name AS threshold, round(CASE WHEN known = 0 OR rate BETWEEN low AND high THEN t ELSE v END, 4) AS value FROM places LEFT JOIN moved USING (name)"""


@_query(_coarse_sql(), "value")
def coarse_thresholds(spark, sf_dir):
    tuned = calibrate.coarse(_measured(spark, sf_dir))
    return spark.createDataFrame([(n, round(float(getattr(tuned, n)), 4)) for _, n, _, _ in SINGLE_RULES], "threshold string, value double")


# ---- jobs, carts, channels --------------------------------------------------------------------------------------

_JOB_KINDS = "CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'restarted' ELSE 'submitted' END WHEN 'view' THEN 'progress' WHEN 'click' THEN 'started' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'noise' END WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'cancel' ELSE 'noise' END END"
_NOW, _SILENT_HOURS = "2024-01-30 00:00:00", 36


@_query(f"""WITH e AS (SELECT user_id::VARCHAR AS job_id, ts AS moment, event_id AS seq, {_JOB_KINDS} AS kind, value FROM events),
known AS (SELECT *, {{'moment': moment, 'seq': seq}} AS t FROM e WHERE kind <> 'noise' AND job_id IS NOT NULL AND moment IS NOT NULL),
begun AS (SELECT job_id, max(t) FILTER (kind IN ('submitted', 'restarted')) AS begun, count(*) FILTER (kind IN ('submitted', 'restarted')) AS n_attempts FROM known GROUP BY job_id),
last AS (SELECT known.*, begun, n_attempts FROM known JOIN begun USING (job_id) WHERE begun IS NULL OR t >= begun),
ended AS (SELECT job_id, arg_min(kind, t) AS ending, min(t) AS ended FROM last WHERE kind IN ('done', 'failed', 'cancelled') GROUP BY job_id),
upto AS (SELECT last.*, ending, ended FROM last LEFT JOIN ended USING (job_id) WHERE ended IS NULL OR t <= ended),
j AS (SELECT job_id, any_value(ending) AS ending, any_value(begun.moment) AS begun_at, any_value(ended.moment) AS ended_at, max(moment) AS seen_at, bool_or(kind IN ('started', 'progress')) AS runs, bool_or(kind = 'cancel') AS cancels,
  arg_max(value, t) FILTER (kind = 'progress' AND value IS NOT NULL) AS progress, any_value(n_attempts) AS n_attempts FROM upto GROUP BY job_id)
SELECT job_id, CASE WHEN ending IS NOT NULL THEN ending WHEN (runs OR cancels) AND epoch_ms(TIMESTAMP '{_NOW}') - epoch_ms(seen_at) > {_SILENT_HOURS * 3_600_000} THEN 'interrupted' WHEN cancels THEN 'cancelling' WHEN runs THEN 'running' ELSE 'queued' END AS status,
  begun_at, seen_at, ended_at, progress, n_attempts FROM j""", "progress")
def job_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.expr(_JOB_KINDS).alias("kind"), "value")
    return jobs.job_states(e, F.lit(_NOW).cast("timestamp"), _SILENT_HOURS * 3_600_000)


_CART_KINDS = "CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'toggle' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'reorder' WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'clear' ELSE 'top_n' END END"
_CART_VALUE = "CASE WHEN event_type = 'signup' THEN 2.0 + event_id % 5 ELSE value END"


@_query(f"""WITH e AS (SELECT user_id AS cart_id, event_id * 7 % 11 AS item, event_id AS seq, {_CART_KINDS} AS kind, {_CART_VALUE} AS value FROM events),
cart AS (SELECT cart_id, max(seq) FILTER (kind = 'clear') AS cleared, arg_max(value, seq) FILTER (kind = 'top_n') AS top FROM e GROUP BY cart_id),
runs AS (SELECT cart_id, item, list([CASE kind WHEN 'add' THEN 1 WHEN 'remove' THEN 2 WHEN 'toggle' THEN 3 ELSE 4 END, CASE WHEN kind = 'reorder' THEN value ELSE seq END]::DOUBLE[] ORDER BY seq) AS ops
  FROM e JOIN cart USING (cart_id) WHERE kind IN ('add', 'remove', 'toggle', 'reorder') AND (cleared IS NULL OR seq > cleared) GROUP BY ALL),
states AS (SELECT cart_id, item, list_reduce(list_concat([[0, 0]::DOUBLE[]], ops), lambda s, o: CASE
    WHEN o[1] = 1 OR (o[1] = 3 AND s[1] = 0) THEN CASE WHEN s[1] = 1 THEN s ELSE [1.0, o[2]] END
    WHEN o[1] = 4 THEN CASE WHEN s[1] = 1 THEN [1.0, o[2]] ELSE s END ELSE [0.0, 0.0] END) AS s FROM runs),
held AS (SELECT cart_id, item, row_number() OVER (PARTITION BY cart_id ORDER BY s[2], item)::INTEGER AS position FROM states WHERE s[1] = 1)
SELECT cart_id, item, position FROM held JOIN cart USING (cart_id) WHERE top IS NULL OR position <= top""")
def cart_contents(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("cart_id"), F.expr("event_id * 7 % 11").alias("item"), F.col("event_id").alias("seq"), F.expr(_CART_KINDS).alias("kind"), F.expr(_CART_VALUE).alias("value"))
    return cart.cart_state(e)


#: What the four channels are built from, and the fields that are for debugging.
REGISTRY = channels.Registry((
    channels.Channel("histogram", lambda t: t["histogram"], "vec_id", labels.LABELS, ("histogram_outlier_score",)),
    channels.Channel("quality_edge", lambda t: t["quality_edge"], "image_path", ("blurry", "sharp", "edge_heavy", "lineart_v2", "high_contrast_v2"), ("lineart_score_v2", "high_contrast_score_v2", "flat_color_score")),
    channels.Channel("basic_metadata", lambda t: t["basic_metadata"], "image_path", (), ("transparent_ratio",)),
    channels.Channel("duplicate_groups", lambda t: t["duplicate_groups"], "path"),
    channels.Channel("model_plugins"),
))


def _capabilities_sql() -> str:
    tables = {"histogram": f"WITH {_summary_sql()} SELECT * FROM summary", "quality_edge": f"{_QUALITY} SELECT * FROM channel", "basic_metadata": METADATA_SQL, "duplicate_groups": f"WITH {_EXACT} SELECT file_size, sha256, path, group_id, image_count FROM exact"}
    of = lambda values: "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]::VARCHAR[]"
    rows = []
    for name, c in sorted(REGISTRY.channels.items()):
        numeric = "column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') OR column_type LIKE 'DECIMAL%'"
        if name not in tables:
            rows.append(f"SELECT '{name}' AS channel, false AS built, false AS buildable, 0 AS field_count, '' AS sort_fields, '' AS filter_fields, '' AS debug_only_fields")
            continue
        fields = f"list_sort(list(column_name) FILTER (({numeric}) AND NOT list_contains({of((c.key, *c.debug))}, column_name)))"
        debug = f"list_sort(list(column_name) FILTER (list_contains({of(c.debug)}, column_name)))"
        rows.append(f"SELECT '{name}', true, true, len({fields})::INTEGER, array_to_string({fields}, ','), CASE WHEN bool_or(column_name = 'labels') THEN array_to_string({of(c.labels)}, ',') ELSE '' END, coalesce(array_to_string({debug}, ','), '') FROM (DESCRIBE {tables[name]})")
    return " UNION ALL ".join(sorted(rows, key=lambda r: "AS channel" not in r))


@_query(_capabilities_sql())
def channel_capabilities(spark, sf_dir):
    built = {"histogram": _channel(spark, sf_dir), "quality_edge": _quality(spark, sf_dir), "basic_metadata": views.metadata(spark, sf_dir), "duplicate_groups": dedup.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")}
    built = {n: REGISTRY.build(n, built) for n in built}
    return REGISTRY.describe(spark, built).select("channel", "built", "buildable", "field_count", *(F.array_join(c, ",").alias(c) for c in ("sort_fields", "filter_fields", "debug_only_fields")))


# ---- stores -----------------------------------------------------------------------------------------------------

@_query("""WITH r AS (SELECT s_suppkey AS image_id, s_nationkey AS c, 'd' || s_suppkey % 7 || '/' || s_suppkey % 5 || '.txt' AS f, (s_suppkey || '|' || s_name) AS body FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY image_id) AS rank, 'cluster_' || lpad(c::VARCHAR, 3, '0') || '_n' AS folder, image_id % 5 AS name FROM r)
SELECT image_id::VARCHAR AS image_id, rank::INTEGER AS rank, folder || '/' || name || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || (row_number() OVER w - 1) END || '.txt' AS target, 'copied' AS status, octet_length(encode(body))::BIGINT AS bytes, sha256(body) AS sha256
FROM k WINDOW w AS (PARTITION BY folder, name ORDER BY rank, image_id)""")
def export_copies(spark, sf_dir):
    """A file for each supplier, copied into a folder for each nation: the status rows of the record."""
    root = storage.shared_root(spark) + f"/export-{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(k.alias("image_id"), F.col("s_nationkey").cast("int").alias("cluster_id"), F.lit("n").alias("cluster_name"), k.alias("position"), F.concat_ws("|", k, "s_name").alias("body"))
    # the folder keeps equal names apart
    files = files.withColumn("path", F.concat(F.lit(f"{root}/in/d"), F.col("image_id") % 7, F.lit("/"), F.col("image_id"), F.lit("/"), F.col("image_id") % 5, F.lit(".txt")))
    copies.write_files(files.select("path", "body")).count()
    plan = export.by_cluster(files.drop("body"))
    copies.export(plan, f"{root}/out", [f"{root}/in"], f"{root}/records", "suppliers")
    return copies.record_rows(spark, f"{root}/records", "suppliers").select("image_id", "rank", "target", "status", "bytes", "sha256")


@_query(f"""WITH f AS ({FEATURES_SQL}), p AS (SELECT cluster_id AS old_cluster, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE cluster_id END AS new_cluster FROM f)
SELECT old_cluster::INTEGER AS old_cluster, new_cluster::INTEGER AS new_cluster, count(*) AS count FROM p GROUP BY ALL""")
def preview_diff(spark, sf_dir):
    """A preview is applied, a second one made against it: how many rows go from which label to which."""
    job = Previews(spark, storage.shared_root(spark) + f"/previews-{uuid.uuid4().hex}")
    points = views.features(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image_id"), "cluster_id", F.col("vec_id").alias("_v"))
    job.apply(job.create(points.drop("_v"), {"name": "first"}, {}))
    second = points.withColumn("cluster_id", F.when(F.col("_v") % 4 == 0, -1).otherwise(F.col("cluster_id"))).drop("_v")
    return job.get(job.create(second, {"name": "second"}, {}))["diff"]


QUERIES |= {name: Query(build, sql, doubles) for name, (build, sql, doubles) in PIXEL_QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in QUERIES.items() if (sql := q.oracle())}
