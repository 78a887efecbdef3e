"""Configuration records.  The values are fixed: results must equal those of the tool this engine replaces."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class LabelConfig:
    """Thresholds of the histogram labels."""

    low_key_dark_ratio: float = 0.4144
    high_key_bright_ratio: float = 0.4086
    high_contrast_dark_ratio: float = 0.2124
    high_contrast_bright_ratio: float = 0.2005
    flat_light_entropy: float = 3.0
    muted_low_sat_ratio: float = 0.5867
    vivid_high_sat_ratio: float = 0.2738
    warm_ratio: float = 0.5802
    cool_ratio: float = 0.5645
    mixed_color_entropy: float = 3.446
    lineart_bright_ratio: float = 0.55
    lineart_low_sat_ratio: float = 0.60
    lineart_dark_ratio: float = 0.03

    def with_(self, **values: float) -> LabelConfig:
        return replace(self, **values)

    @classmethod
    def merged(cls, saved: dict) -> LabelConfig:
        """Saved values over the defaults; unknown keys are dropped."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: float(v) for k, v in saved.items() if k in known})


# Wanted share of images for each label, by profile.
TARGET_RANGES = {
    "default": {
        "low_key": (0.05, 0.30),
        "high_key": (0.05, 0.30),
        "muted": (0.05, 0.40),
        "vivid": (0.03, 0.25),
        "warm": (0.10, 0.65),
        "cool": (0.10, 0.65),
        "mixed_color": (0.03, 0.15),
        "high_contrast": (0.02, 0.15),
        "flat_light": (0.05, 0.25),
    },
    "conservative": {
        "low_key": (0.05, 0.25),
        "high_key": (0.05, 0.25),
        "muted": (0.05, 0.25),
        "vivid": (0.02, 0.15),
        "warm": (0.10, 0.60),
        "cool": (0.10, 0.60),
        "mixed_color": (0.02, 0.10),
        "high_contrast": (0.02, 0.10),
        "flat_light": (0.05, 0.20),
    },
    "broad": {
        "low_key": (0.05, 0.40),
        "high_key": (0.05, 0.40),
        "muted": (0.05, 0.40),
        "vivid": (0.03, 0.30),
        "warm": (0.10, 0.70),
        "cool": (0.10, 0.70),
        "mixed_color": (0.03, 0.20),
        "high_contrast": (0.02, 0.20),
        "flat_light": (0.05, 0.30),
    },
}

# Label, its threshold, the field that is compared, and how.
SINGLE_RULES = (
    ("low_key", "low_key_dark_ratio", "brightness_dark_ratio", ">"),
    ("high_key", "high_key_bright_ratio", "brightness_bright_ratio", ">"),
    ("muted", "muted_low_sat_ratio", "saturation_low_ratio", ">"),
    ("vivid", "vivid_high_sat_ratio", "saturation_high_ratio", ">"),
    ("warm", "warm_ratio", "hue_warm_ratio", ">"),
    ("cool", "cool_ratio", "hue_cool_ratio", ">"),
    ("mixed_color", "mixed_color_entropy", "hue_entropy", ">"),
    ("flat_light", "flat_light_entropy", "brightness_entropy", "<"),
)

# The default 16 features, by group.
FEATURE_GROUPS = {
    "brightness": ("brightness_mean", "brightness_std", "brightness_p10", "brightness_p90"),
    "lighting": ("contrast", "highlight_threshold", "edge_strength_mean", "edge_strength_std"),
    "color": ("warm_cool_bias", "saturation_mean", "saturation_std"),
    "spatial_lighting": ("light_centroid_x", "light_centroid_y", "light_spread", "light_concentration", "light_asymmetry"),
}
FEATURES = tuple(f for group in FEATURE_GROUPS.values() for f in group)

# All 20 features that recipes pick from, in their order, and those that never cluster.
RECIPE_FEATURES = (
    "brightness_mean", "brightness_std", "brightness_p10", "brightness_p90", "brightness_skewness",
    "contrast", "highlight_threshold", "edge_strength_mean", "edge_strength_std",
    "warm_cool_bias_weighted", "saturation_mean", "saturation_std", "low_saturation_ratio", "high_saturation_ratio", "dominant_hue_strength",
    "light_centroid_x", "light_centroid_y", "light_spread", "light_concentration", "light_asymmetry",
)
METADATA_ONLY = ("low_saturation_ratio", "high_saturation_ratio", "dominant_hue_strength")


@dataclass(frozen=True)
class Recipe:
    """Which features cluster, with what weights and settings."""

    name: str
    features: tuple[str, ...] = tuple(f for f in RECIPE_FEATURES if f not in (*METADATA_ONLY, "brightness_skewness", "warm_cool_bias_weighted"))
    extra: tuple[str, ...] = ("legacy_warm_cool_bias",)
    neighbors: int = 50
    min_dist: float = 0.05
    components: int = 5
    cluster_size_ratio: float = 0.015
    min_samples_ratio: float = 0.3
    weights: tuple[tuple[str, float], ...] = tuple((g, 1.0) for g in FEATURE_GROUPS)
    seed: int = 42

    def problems(self) -> list[str]:
        """What is wrong with the recipe; nothing when it can run."""
        out = [f"unknown feature: {f}" for f in self.features if f not in RECIPE_FEATURES]
        out += [f"metadata-only feature: {f}" for f in self.features if f in METADATA_ONLY]
        if not self.features:
            out.append("no features")
        if not 0 < self.cluster_size_ratio < 1:
            out.append("cluster_size_ratio must lie between 0 and 1")
        return out


# The built-in recipes.
RECIPES = {
    "default_legacy16_raw_015": Recipe("default_legacy16_raw_015"),
    "preview_high_granularity": Recipe("preview_high_granularity", neighbors=30, min_dist=0.02, cluster_size_ratio=0.008, min_samples_ratio=0.2),
    "preview_low_granularity": Recipe("preview_low_granularity", neighbors=80, min_dist=0.1, cluster_size_ratio=0.03, min_samples_ratio=0.5),
}

# Weights of the groups in each preset; a group with weight 0 is off.
PRESETS = {
    "lighting": {"brightness": 1.0, "lighting": 1.0, "color": 0.0, "depth": 1.0, "coupling": 1.0},
    "color": {"brightness": 0.5, "lighting": 0.0, "color": 1.5, "depth": 0.0, "coupling": 0.0},
    "geometry": {"brightness": 0.0, "lighting": 0.0, "color": 0.0, "depth": 1.0, "coupling": 1.0},
    "full": {"brightness": 1.0, "lighting": 1.0, "color": 1.0, "depth": 1.0, "coupling": 1.0},
}


def preset(name: str, current: dict[str, float] | None = None) -> dict[str, float]:
    """Weights by group of a preset; ``custom`` keeps the current ones."""
    if name == "custom":
        return dict(current or {})
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(PRESETS)} and custom")
    return dict(PRESETS[name])


# Group, tag, and its rules of feature, direction and weight.
TAG_RULES = {
    "brightness": {
        "dark": [("brightness_mean", "low", 2.0), ("brightness_p10", "low", 1.0)],
        "dim": [("brightness_mean", "low", 1.0), ("brightness_p90", "low", 1.0)],
        "balanced": [("brightness_mean", "mid", 1.0)],
        "bright": [("brightness_mean", "high", 1.0), ("brightness_p90", "high", 1.0)],
        "high_key": [("brightness_mean", "high", 2.0), ("brightness_p10", "high", 1.0)],
        "highlight_pop": [("brightness_skewness", "high", 1.5)],
        "ink_shadow": [("brightness_skewness", "low", 1.5)],
    },
    "lighting": {
        "flat": [("contrast", "low", 2.0), ("edge_strength_mean", "low", 1.0)],
        "soft": [("contrast", "low", 1.0)],
        "dramatic": [("contrast", "high", 2.0), ("edge_strength_std", "high", 1.0)],
        "harsh": [("contrast", "high", 1.0), ("edge_strength_mean", "high", 1.5)],
        "specular": [("highlight_threshold", "high", 2.0)],
    },
    "color": {
        "warm": [("warm_cool_bias_weighted", "high", 2.0)],
        "cool": [("warm_cool_bias_weighted", "low", 2.0)],
        "neutral": [("warm_cool_bias_weighted", "mid", 1.5)],
        "muted": [("saturation_mean", "low", 1.5), ("low_saturation_ratio", "high", 1.0)],
        "vivid": [("saturation_mean", "high", 1.5), ("high_saturation_ratio", "high", 1.0)],
        "rich": [("saturation_mean", "high", 1.5), ("saturation_std", "high", 1.0)],
        "pastel": [("saturation_mean", "low", 1.5), ("warm_cool_bias_weighted", "mid", 0.5)],
        "mono_tone": [("dominant_hue_strength", "high", 1.0)],
    },
    "spatial": {
        "center_light": [("light_centroid_x", "mid", 1.5), ("light_centroid_y", "mid", 1.5)],
        "side_light": [("light_centroid_x", "high", 1.5), ("light_centroid_y", "mid", 0.5)],
        "left_light": [("light_centroid_x", "low", 2.0)],
        "right_light": [("light_centroid_x", "high", 2.0)],
        "top_light": [("light_centroid_y", "low", 2.0)],
        "bottom_light": [("light_centroid_y", "high", 2.0)],
        "spotlight": [("light_concentration", "high", 2.0), ("light_spread", "low", 1.5)],
        "even_light": [("light_spread", "high", 1.5), ("light_concentration", "low", 1.0)],
        "focused": [("light_spread", "low", 1.5)],
        "diffuse": [("light_spread", "high", 1.5)],
    },
    "depth": {
        "flat_depth": [("depth_variance", "low", 2.0)],
        "layered": [("depth_variance", "high", 1.5), ("depth_entropy", "high", 1.5)],
        "deep_space": [("depth_variance", "high", 2.0), ("foreground_background_depth_gap", "high", 1.0)],
        "compressed": [("foreground_background_depth_gap", "low", 2.0)],
        "foreground_focus": [("depth_variance", "mid", 1.0), ("foreground_background_depth_gap", "high", 1.5)],
    },
}
