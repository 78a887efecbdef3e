"""Tables of runs: recipe scores against baselines, tuning objectives, stability over repeats, label names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a tag is called in the localised names.
TAG_NAMES = {
    "dark": "暗调",
    "dim": "低亮",
    "balanced": "均衡",
    "bright": "明亮",
    "high_key": "高调",
    "highlight_pop": "高光突出",
    "ink_shadow": "重阴影",
    "flat": "平光",
    "soft": "柔光",
    "dramatic": "戏剧光",
    "harsh": "硬光",
    "specular": "强反光",
    "warm": "暖色",
    "cool": "冷色",
    "neutral": "中性色",
    "muted": "低饱和",
    "vivid": "鲜艳",
    "rich": "浓郁色彩",
    "pastel": "柔和彩色",
    "mono_tone": "单色倾向",
    "center_light": "居中光",
    "side_light": "侧光",
    "left_light": "左侧光",
    "right_light": "右侧光",
    "top_light": "顶光",
    "bottom_light": "底光",
    "spotlight": "聚光",
    "even_light": "均匀光",
    "focused": "聚焦光",
    "diffuse": "漫射光",
    "flat_depth": "浅景深",
    "layered": "层次感",
    "deep_space": "深空间",
    "compressed": "压缩空间",
    "foreground_focus": "前景突出",
}


def localized(name: Column, names: dict[str, str] = TAG_NAMES, most: int = 4) -> Column:
    """A cluster name's tags in the other language, longer tags first, at most four; the name itself where it has none."""
    tags = sorted(names, key=lambda t: (-len(t), list(names).index(t)))
    found = F.regexp_extract_all(name, F.lit(f"(?<![a-z])({'|'.join(tags)})(?![a-z])"), F.lit(1))
    ordered = F.filter(F.array(*map(F.lit, tags)), lambda t: F.array_contains(found, t))
    words = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    shown = F.array_join(F.transform(F.slice(ordered, 1, most), lambda t: words[t]), " · ")
    return F.when(F.lower(name) == "noise", "未归类").when(shown == "", F.replace(name, F.lit("_"), F.lit(" "))).otherwise(shown)


def recipe_scores(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """recipe and its averages over datasets: score, and differences from the baselines where there are any.

    runs (recipe, dataset, silhouette, noise_rate in percent, n_clusters,
    largest_cluster_ratio); baselines (dataset, silhouette, noise_rate,
    clusters).
    """
    base = baselines.select("dataset", F.col("silhouette").alias("b_sil"), F.col("noise_rate").alias("b_noise"), F.col("clusters").alias("b_clusters"))
    c = F.col
    zero = F.lit(0.0)
    sil, noise, clusters = c("silhouette") - c("b_sil"), c("noise_rate") - c("b_noise"), F.abs(c("n_clusters") - c("b_clusters"))
    against = F.greatest(zero, 100 - F.greatest(zero, -sil) * 200) - F.least(F.lit(30.0), F.greatest(zero, noise * 2)) - F.least(F.lit(20.0), clusters * 5)
    alone = F.least(F.lit(100.0), c("silhouette") * 150) - F.least(F.lit(30.0), c("noise_rate") * 1.5) - F.when(c("largest_cluster_ratio") > 0.5, 20.0).otherwise(0.0)
    scored = runs.join(base, "dataset", "left").select("recipe", F.greatest(zero, F.when(c("b_sil").isNotNull(), against).otherwise(alone)).alias("s"), sil.alias("sil"), F.abs(noise).alias("noise"), clusters.alias("clusters"))
    return scored.groupBy("recipe").agg(
        F.round(F.avg("s"), 1).alias("avg_composite_score"),
        F.round(F.avg("sil"), 4).alias("avg_silhouette_delta"),
        F.round(F.avg("noise"), 2).alias("avg_noise_rate_abs_delta"),
        F.round(F.avg("clusters"), 1).alias("avg_cluster_count_abs_delta"),
        F.count("sil").alias("datasets_with_baseline"),
    )


def objective(scores: DataFrame) -> DataFrame:
    """trial and 0.7 of its mean score over baseline datasets plus 0.3 of that over the others (trial, score, is_baseline)."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("score"))), F.lit(0.0))
    return scores.groupBy("trial").agg((0.7 * mean(F.col("is_baseline")) + 0.3 * mean(~F.col("is_baseline"))).alias("objective"))


def repeat_stats(runs: DataFrame, limit: float = 0.02) -> DataFrame:
    """dataset and the spread over repeated runs; stable if no silhouette is ``limit`` or more off the mean."""
    by = runs.groupBy("dataset").agg(
        F.avg("silhouette").alias("mean_silhouette"),
        F.stddev_pop("silhouette").alias("std_silhouette"),
        F.min("silhouette").alias("low"),
        F.max("silhouette").alias("high"),
        (F.max("n_clusters") - F.min("n_clusters")).alias("cluster_range"),
        (F.max("largest_cluster_ratio") - F.min("largest_cluster_ratio")).alias("largest_range"),
    )
    deviation = F.greatest(F.col("high") - F.col("mean_silhouette"), F.col("mean_silhouette") - F.col("low"))
    return by.select("dataset", "mean_silhouette", "std_silhouette", (F.col("high") - F.col("low")).alias("silhouette_range"), "cluster_range", "largest_range", deviation.alias("max_deviation"), (deviation < limit).alias("stable"))
