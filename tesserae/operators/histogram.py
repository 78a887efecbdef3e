"""The histogram channel: bins, residuals against the dataset, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import labels
from tesserae.functions.config import LabelConfig
from tesserae.functions.scalars import array_sum, hist_entropy
from tesserae.sources.storage import written

BRIGHTNESS_BINS, SATURATION_BINS, HUE_BINS = 16, 16, 24
EPS = 1e-6


def histogram(values: Column, low: float, high: float, bins: int) -> Column:
    """Share of the values in each of ``bins`` equal bins; the last one is closed, values outside are dropped.

    All zero where no value lies inside.
    """
    inside = F.filter(values, lambda v: (v >= low) & (v <= high))
    at = F.transform(inside, lambda v: F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)))
    n = F.greatest(F.size(inside), F.lit(1)).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)) / n)


def all_residuals(df: DataFrame, hists: dict[str, int]) -> DataFrame:
    """``df`` with {hist}_z (residual by the bin's population deviation) and {hist}_outlier (its length) of each histogram.

    The rows are written once: histograms are costly to work out, and every bin's
    aggregates would do so anew.  The means and deviations of all bins are one
    aggregate row, so one pass for all histograms together; rows aren't shuffled.
    """
    df = written(df, "bank")
    row = df.agg(*(f(F.get(h, F.lit(b))).alias(f"{n}_{h}_{b}") for h, bins in hists.items() for b in range(bins) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    zs = {}
    for h, bins in hists.items():
        mean, std = (F.array(*(F.lit(float(row[f"{n}_{h}_{b}"] or 0.0)) for b in range(bins))) for n in "ms")
        zs[f"{h}_z"] = _z(h, mean, std)
    out = df.withColumns(zs)
    return out.withColumns({f"{h}_outlier": F.sqrt(array_sum(F.transform(f"{h}_z", lambda x: x * x))) for h in hists})


def _z(hist: str, mean: Column, std: Column) -> Column:
    return F.transform(hist, lambda x, i: (x - F.get(mean, i)) / (F.get(std, i) + EPS))


def residuals(df: DataFrame, hist: str, bins: int) -> DataFrame:
    """``all_residuals`` of one histogram."""
    return all_residuals(df, {hist: bins})


def summary(df: DataFrame, config: LabelConfig = LabelConfig(), digits: int | None = 4) -> DataFrame:
    """The 21 measures and the labels of each row, from its three histograms, hue_valid and three outlier scores.

    Labels are decided on unrounded measures; without ``digits`` the measures
    stay so, for other thresholds to be tried on them.  Other columns of ``df``
    stay in front.
    """
    b, s, h = F.col("brightness_hist"), F.col("saturation_hist"), F.col("hue_hist")
    part = lambda x, first, n: array_sum(F.slice(x, first + 1, n))
    hue = F.coalesce(F.col("hue_valid"), F.lit(False))
    has_hue = hue & (array_sum(h) > 0)
    raw = {
        "brightness_dark_ratio": part(b, 0, 4),
        "brightness_midtone_ratio": part(b, 4, 8),
        "brightness_bright_ratio": part(b, 12, 4),
        "brightness_entropy": hist_entropy(b),
        "brightness_peak_count": F.size(F.filter(b, lambda x: x > array_sum(b) / F.size(b) * 1.5)),
        "brightness_outlier_score": F.col("brightness_hist_outlier"),
        "saturation_low_ratio": part(s, 0, 4),
        "saturation_mid_ratio": part(s, 4, 8),
        "saturation_high_ratio": part(s, 12, 4),
        "saturation_entropy": hist_entropy(s),
        "saturation_outlier_score": F.col("saturation_hist_outlier"),
        "hue_warm_ratio": F.when(has_hue, part(h, 0, 5)).otherwise(0.0),
        "hue_cool_ratio": F.when(has_hue, part(h, 11, 10)).otherwise(0.0),
        "hue_entropy": F.when(hue, hist_entropy(h)).otherwise(0.0),
        "hue_dominant_bin": F.when(has_hue, (F.array_position(h, F.array_max(h)) - 1).cast("int")).otherwise(-1),
        "hue_outlier_score": F.col("hue_hist_outlier"),
        "histogram_outlier_score": F.sqrt(F.col("brightness_hist_outlier") ** 2 + F.col("saturation_hist_outlier") ** 2 + F.col("hue_hist_outlier") ** 2),
    }
    kept = [c for c in df.columns if c not in raw]
    out = df.select(*kept, *(v.alias(k) for k, v in raw.items()))
    out = out.withColumn("labels", labels.joined(labels.masks(config)))
    return out if digits is None else out.withColumns({k: F.round(k, digits) for k in raw if k.endswith(("ratio", "entropy", "score"))})


def channel(df: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Residuals of the three histogram columns, then the summary."""
    return summary(all_residuals(df, {"brightness_hist": BRIGHTNESS_BINS, "saturation_hist": SATURATION_BINS, "hue_hist": HUE_BINS}), config)
