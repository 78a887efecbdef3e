"""Label rules over histogram and quality summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.config import LabelConfig


#: The histogram labels in the order that label strings have.
LABELS = ("low_key", "high_key", "high_contrast", "flat_light", "muted", "vivid", "warm", "cool", "mixed_color", "lineart_like_candidate")


def masks(cfg: LabelConfig = LabelConfig(), has_hue: bool = True) -> dict[str, Column]:
    """A boolean column for each histogram label, in the order that label strings have.

    A comparison with a missing value is false.  Without a hue_valid column
    (``has_hue`` false) no hue label holds.
    """
    c = F.col
    hue = F.coalesce(c("hue_valid"), F.lit(False)) if has_hue else F.lit(False)
    rules = {
        "low_key": c("brightness_dark_ratio") > cfg.low_key_dark_ratio,
        "high_key": c("brightness_bright_ratio") > cfg.high_key_bright_ratio,
        "high_contrast": (c("brightness_dark_ratio") > cfg.high_contrast_dark_ratio) & (c("brightness_bright_ratio") > cfg.high_contrast_bright_ratio),
        "flat_light": c("brightness_entropy") < cfg.flat_light_entropy,
        "muted": c("saturation_low_ratio") > cfg.muted_low_sat_ratio,
        "vivid": c("saturation_high_ratio") > cfg.vivid_high_sat_ratio,
        "warm": hue & (c("hue_warm_ratio") > cfg.warm_ratio),
        "cool": hue & (c("hue_cool_ratio") > cfg.cool_ratio),
        "mixed_color": hue & (c("hue_entropy") > cfg.mixed_color_entropy),
        "lineart_like_candidate": (c("brightness_bright_ratio") > cfg.lineart_bright_ratio)
        & (c("saturation_low_ratio") > cfg.lineart_low_sat_ratio)
        & (c("brightness_dark_ratio") > cfg.lineart_dark_ratio),
    }
    return {k: F.coalesce(rules[k], F.lit(False)) for k in LABELS}


def joined(rules: dict[str, Column], empty: str = "unclassified") -> Column:
    """The names of the rules that hold, joined by ``;``."""
    names = F.concat_ws(";", *(F.when(v, F.lit(k)) for k, v in rules.items()))
    return F.when(names == "", F.lit(empty)).otherwise(names)


def unclassified(rules: dict[str, Column]) -> Column:
    """Whether no label but the line-art candidate holds."""
    return ~reduce(lambda a, b: a | b, (v for k, v in rules.items() if k != "lineart_like_candidate"))


def quality_masks(blurry: Column | None = None) -> dict[str, Column]:
    """The labels of the quality channel; ``blurry`` is relative to the dataset and comes first."""
    c = F.col
    rules = {} if blurry is None else {"blurry": blurry}
    rules |= {
        "sharp": c("sharpness_score") > 4,
        "edge_heavy": c("edge_density") > 0.15,
        "lineart_v2": c("lineart_score_v2") > 0.55,
        "high_contrast_v2": c("high_contrast_score_v2") > 0.55,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def has_label(labels: Column, label: str, strict: bool = True) -> Column:
    """Whether a joined label string has a label; not strict: as a substring."""
    return F.array_contains(F.split(labels, ";"), label) if strict else F.contains(labels, F.lit(label))


def depth_consistency(edge_depth_variance: Column, confidence: Column, least_variance: float = 0.01, least_confidence: float = 0.5) -> Column:
    """What a shadow is: ``fake_shadow`` where the depth is uncertain, ``cast_shadow`` where it is even, else ``form_shadow``."""
    return F.when(confidence < least_confidence, "fake_shadow").when(edge_depth_variance < least_variance, "cast_shadow").otherwise("form_shadow")


def blur_level(laplacian_variance: Column, threshold: float = 60.0) -> Column:
    """``review_blurry`` below the threshold, else ``ok``; a mark for review only."""
    return F.when(laplacian_variance < threshold, "review_blurry").otherwise("ok")
