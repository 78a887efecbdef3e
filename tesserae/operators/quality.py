"""The quality channel: scores from edges and histograms, labels, the blur flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import labels
from tesserae.operators.quantiles import quantiles

KEY = "image_path"
# What the scores take for an image without a histogram row.
DEFAULTS = {"brightness_bright_ratio": 0.3, "brightness_dark_ratio": 0.3, "saturation_low_ratio": 0.5}


def scores(quality: DataFrame, histogram: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """``quality`` (edge_density, local_contrast_p95, ...) with the three scores and whether a histogram was found."""
    fields = list(DEFAULTS)
    if histogram is None:
        joined = quality.select("*", *(F.lit(None).cast("double").alias(f) for f in fields), F.lit(False).alias("_hist_found"))
    else:
        side = histogram.select(KEY, *fields, F.lit(True).alias("_hist_found")).dropDuplicates([KEY])
        joined = quality.join(side, KEY, "left").withColumn("_hist_found", F.coalesce("_hist_found", F.lit(False)))
    b, d, s = (F.coalesce(F.col(f), F.lit(v)) for f, v in DEFAULTS.items())
    e = F.least(F.col("edge_density") * 5, F.lit(1.0))
    c = F.least(F.col("local_contrast_p95") * 20, F.lit(1.0))
    return joined.select(
        *quality.columns,
        "_hist_found",
        F.round(0.35 * b + 0.25 * s + 0.25 * e + 0.15 * c, digits).alias("lineart_score_v2"),
        F.round(0.3 * d + 0.3 * b + 0.2 * c + 0.2 * e, digits).alias("high_contrast_score_v2"),
        F.round(1 - F.least((e + c) / 2, F.lit(1.0)), digits).alias("flat_color_score"),
    )


def label(scored: DataFrame) -> DataFrame:
    """Labels, and the flag for a sharpness below the dataset's 10th percentile; ``blurry`` is among the labels."""
    (limit,) = quantiles(scored, {"sharpness_score": [0.1]})["sharpness_score"]
    blurry = F.coalesce(F.col("sharpness_score") < F.lit(limit), F.lit(False))
    rules = labels.quality_masks(blurry)
    return scored.select("*", labels.joined(rules, "normal").alias("labels"), blurry.alias("is_blurry_candidate"))


def channel(quality: DataFrame, histogram: DataFrame | None = None, digits: int = 4) -> DataFrame:
    return label(scores(quality, histogram, digits))
