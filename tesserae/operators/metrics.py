"""Measures of a clustering: silhouette, Davies-Bouldin, Rand index, cohesion, entropy, health, differences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.stats import distinctiveness

#: Points that are broadcast at once when every point's distance to all others is needed.
BLOCK = 20_000


def distance_sums(df: DataFrame, names: Sequence[str], key: str, cluster: str) -> DataFrame:
    """key, own (the row's cluster), cluster, total distance to that cluster's points and their number.

    Exact and quadratic by nature.  The other points come in blocks of about
    BLOCK rows, each broadcast by itself, and a block's sums are matrix
    products, so no row is joined with all rows.
    """
    spark = df.sparkSession
    rows = df.select(key, cluster, *(F.col(n).cast("double") for n in names))
    n_blocks = 1 + rows.count() // BLOCK
    out = None
    for k in range(n_blocks):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == k).toPandas()
        if part.empty:
            continue
        shared = spark.sparkContext.broadcast((part[list(names)].to_numpy(), part[cluster].to_numpy()))

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            points, of = shared.value
            ids, at = np.unique(of, return_inverse=True)
            one = np.zeros((len(of), len(ids)))
            one[np.arange(len(of)), at] = 1.0
            for batch in batches:
                for start in range(0, len(batch), 256):
                    b = batch.iloc[start : start + 256]
                    x = b[list(names)].to_numpy()
                    d = np.sqrt(np.maximum(((x[:, None, :] - points[None, :, :]) ** 2).sum(axis=2), 0.0)) if len(points) * len(x) * len(names) < 4e7 else _distances(x, points)
                    total = d @ one
                    yield pd.DataFrame({"key": np.repeat(b[key].to_numpy(), len(ids)), "own": np.repeat(b[cluster].to_numpy(), len(ids)), "cluster": np.tile(ids, len(b)), "total": total.ravel(), "n": np.tile(one.sum(axis=0).astype(np.int64), len(b))})

        kind = dict(rows.dtypes)
        part_sums = rows.mapInPandas(sums, f"key {kind[key]}, own {kind[cluster]}, cluster {kind[cluster]}, total double, n long")
        out = part_sums if out is None else out.unionAll(part_sums)
    if out is None:
        return spark.createDataFrame([], "key long, own int, cluster int, total double, n long")
    return out if n_blocks == 1 else out.groupBy("key", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0))


def silhouettes(df: DataFrame, names: Sequence[str], key: str, cluster: str = "cluster_id") -> DataFrame:
    """key, cluster and silhouette (Euclidean) of every row; 0 in a cluster of one."""
    sums = distance_sums(df, names, key, cluster)
    mean = F.when(F.col("own") == F.col("cluster"), F.col("total") / (F.col("n") - 1)).otherwise(F.col("total") / F.col("n"))
    by = sums.groupBy("key", "own").agg(
        F.max(F.when((F.col("own") == F.col("cluster")) & (F.col("n") > 1), mean)).alias("a"),
        F.min(F.when(F.col("own") != F.col("cluster"), mean)).alias("b"),
    )
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return by.select(F.col("key").alias(key), F.col("own").alias(cluster), s.alias("silhouette"))


def silhouette(df: DataFrame, names: Sequence[str], key: str, cluster: str = "cluster_id", noise: bool = False) -> DataFrame:
    """One row: the mean silhouette; noise is left out unless it shall count as a cluster."""
    rows = df if noise else df.where(F.col(cluster) >= 0)
    return silhouettes(rows, names, key, cluster).agg(F.round(F.avg("silhouette"), 4).alias("silhouette_score"))


def centroids(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *(F.avg(n).alias(f"c_{n}") for n in names))


def spreads(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """The centroid of each cluster and its rows' mean distance to it."""
    center = centroids(df, names, cluster)
    far = F.sqrt(sum(((F.col(n) - F.col(f"c_{n}")) ** 2 for n in names), F.lit(0.0)))
    mean = df.join(center, cluster).groupBy(cluster).agg(F.avg(far).alias("spread"))
    return center.join(mean, cluster)


def davies_bouldin(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """One row: the Davies-Bouldin index; noise counts as a cluster.  Pairs are of clusters, not of rows."""
    of = spreads(df, names, cluster)
    x, y = of.alias("x"), of.alias("y")
    gap = F.sqrt(sum(((F.col(f"x.c_{n}") - F.col(f"y.c_{n}")) ** 2 for n in names), F.lit(0.0)))
    worst = x.join(y, F.col(f"x.{cluster}") != F.col(f"y.{cluster}")).groupBy(F.col(f"x.{cluster}")).agg(F.max((F.col("x.spread") + F.col("y.spread")) / gap).alias("r"))
    return worst.agg(F.round(F.avg("r"), 4).alias("davies_bouldin_score"))


def cohesion(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """One row: the mean over clusters of more than one row of their mean distance to the centroid."""
    return spreads(df.where(F.col(cluster) >= 0), names, cluster).where("n > 1").agg(F.round(F.coalesce(F.avg("spread"), F.lit(0.0)), 4).alias("cohesion"))


def label_entropy(df: DataFrame, cluster: str = "cluster_id", most: int = 10) -> DataFrame:
    """One row: the entropy of cluster sizes by its maximum for up to ``most`` clusters."""
    sizes = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("n"))
    p = sizes.select((F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("p"))
    h = p.agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("k"))
    return h.select(F.round(F.when(F.col("k") > 1, F.col("h") / F.log2(F.least(F.col("k"), F.lit(most)).cast("double"))).otherwise(0.0), 4).alias("label_entropy"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings of the same rows, from their contingency table."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    of = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(name))
    sums = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    x, y = of(a, "x").first()[0] or 0.0, of(b, "y").first()[0] or 0.0
    expected = F.lit(float(x * y)) / pairs(F.col("all"))
    most = F.lit((x + y) / 2)
    return sums.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("adjusted_rand_index"))


def sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: rows, clusters, noise count and rate, share of the largest cluster."""
    by = df.groupBy(cluster).agg(F.count("*").alias("n"))
    real = F.col(cluster) >= 0
    out = by.agg(F.sum("n").alias("total"), F.count_if(real).alias("clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise"), F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("largest"))
    return out.select("total", "clusters", "noise", F.round(F.col("noise") / F.col("total"), 4).alias("noise_rate"), F.round(F.col("largest") / F.col("total"), 4).alias("largest_ratio"))


def health(df: DataFrame, names: Sequence[str], key: str, cluster: str = "cluster_id") -> DataFrame:
    """One row: silhouette (noise as a cluster), balance, noise, distinctiveness, the score and its level, and extreme clusters."""
    real = df.where(F.col(cluster) >= 0)
    n = df.count()
    by = real.groupBy(cluster).agg(F.count("*").alias("size")).withColumn("ratio", F.col("size") / F.lit(n))
    mean = distinctiveness(df, names, cluster).agg(F.avg("distinctiveness").alias("mean_distinctiveness")).first()[0] or 0.0
    k = by.count()
    sil = (silhouette(df, names, key, cluster, noise=True).first()[0] or 0.0) if k >= 2 else 0.0
    shape = by.agg(
        F.coalesce(F.max("ratio"), F.lit(0.0)).alias("largest"),
        F.sort_array(F.collect_list(F.when(F.col("ratio") < 0.01, F.col(cluster)))).alias("micro_clusters"),
        F.sort_array(F.collect_list(F.when(F.col("ratio") > 0.5, F.col(cluster)))).alias("dominant_clusters"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("kept"),
    )
    balance = F.lit(0.5) if k <= 1 else F.least(1 - (F.col("largest") - 1.0 / k), F.lit(0.5)) * 2
    noise = 1 - F.col("kept") / F.lit(max(n, 1))
    score = F.round(0.25 * max(sil, 0.0) + 0.25 * balance + 0.25 * (1 - noise) + 0.25 * min(mean / 2, 1.0), 4)
    out = shape.select(F.lit(sil).alias("silhouette"), F.round(noise, 4).alias("noise_ratio"), F.lit(round(mean, 4)).alias("mean_distinctiveness"), score.alias("health_score"), "micro_clusters", "dominant_clusters")
    s = F.col("health_score")
    return out.withColumn("health_level", F.when(s >= 0.7, "healthy").when(s >= 0.4, "moderate").otherwise("unhealthy"))


def final_quality(health_row: DataFrame, oversized_share: float) -> DataFrame:
    """The final score: silhouette, noise and the share outside oversized clusters by 0.4, 0.3 and 0.3."""
    return health_row.withColumn("final_quality_score", F.round(0.4 * F.greatest(F.col("silhouette"), F.lit(0.0)) + 0.3 * (1 - F.col("noise_ratio")) + 0.3 * F.lit(1 - oversized_share), 4))


def advice(level: str, dominant: int, clusters: int, weak: int, noise: float, low_features: int, features: int) -> list[tuple[str, str]]:
    """Problems of a clustering and what to change, in order; none when it is fine."""
    rules = [
        (dominant > 0, "dominant_cluster", "reduce umap_neighbors"),
        (clusters <= 2 and level != "healthy", "over_smoothing", "try pipeline_a"),
        (weak / max(clusters, 1) > 0.3, "too_many_weak_clusters", "increase min_cluster_size"),
        (noise > 0.2, "excessive_noise", "decrease min_cluster_size"),
        (low_features > 0.3 * features, "feature_collapse", "investigate low_contribution features"),
    ]
    return [(problem, change) for holds, problem, change in rules if holds] or [("none", "none")]


def pipeline_score(silhouette_: float, noise_ratio: float, clusters: int, db: float) -> float:
    """The score by which two clusterings of one dataset are compared."""
    return 0.3 * silhouette_ + 0.2 * (1 - noise_ratio) + 0.2 * np.log(max(clusters, 1)) / np.log(50) + 0.3 * (max(0.0, 1 - db / 5) if db > 0 else 0.0)


def experiment_scores(runs: DataFrame) -> DataFrame:
    """``runs`` (mode, noise_rate, largest_cluster_ratio, silhouette, histogram_cohesion, quality_cohesion, label_entropy, changed_image_ratio) with eliminated and score."""
    c = F.col
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    out = (c("noise_rate") > 0.35) | (c("largest_cluster_ratio") > 0.55) | (F.startswith(c("mode"), F.lit("C")) & (c("changed_image_ratio") > 0.40))
    score = (
        0.30 * clip(c("silhouette") + 0.5)
        + 0.25 * clip(1 - c("histogram_cohesion") * 5)
        + 0.15 * clip(1 - c("quality_cohesion") * 3)
        + 0.15 * c("label_entropy")
        - 0.10 * F.greatest(F.lit(0.0), (c("noise_rate") - 0.15) * 2)
        - 0.10 * F.greatest(F.lit(0.0), (c("largest_cluster_ratio") - 0.30) * 2)
    )
    return runs.select("*", out.alias("eliminated"), F.when(out, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), score), 4)).alias("score"))


def label_changes(df: DataFrame, key: str, old: str, new: str, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """One row of what changed between two labellings, and the first changed rows by key."""
    n = F.count("*")
    row = df.agg(n.alias("total_images"), F.count_if(F.col(old) != F.col(new)).alias("changed_cluster_count"), F.round(F.avg((F.col(old) != F.col(new)).cast("double")), 4).alias("changed_cluster_ratio"))
    for name, col in (("old", old), ("new", new)):
        s = sizes(df, col).select(F.col("clusters").alias(f"{name}_cluster_count"), F.col("noise").alias(f"{name}_noise_count"), F.col("noise_rate").alias(f"{name}_noise_rate"), F.col("largest_ratio").alias(f"{name}_largest_cluster_ratio"))
        row = row.withColumns({c: F.lit(v).cast(dict(s.dtypes)[c]) for c, v in s.first().asDict().items()})
    changes = df.where(F.col(old) != F.col(new)).select(key, F.col(old).alias("old_cluster"), F.col(new).alias("new_cluster")).orderBy(key).limit(most)
    return row, changes


def recluster_risks(diff: DataFrame) -> DataFrame:
    """Errors and warnings of a preview, from a row of :func:`label_changes`."""
    c = F.col
    rules = [
        ("error:changed", c("changed_cluster_ratio") > 0.40),
        ("warning:changed", c("changed_cluster_ratio").between(0.25, 0.40) & (c("changed_cluster_ratio") > 0.25)),
        ("error:noise", c("new_noise_rate") > 0.35),
        ("warning:noise", (c("new_noise_rate") <= 0.35) & (c("new_noise_rate") - c("old_noise_rate") > 0.10)),
        ("error:largest", c("new_largest_cluster_ratio") > 0.55),
        ("warning:largest", (c("new_largest_cluster_ratio") > 0.45) & (c("new_largest_cluster_ratio") <= 0.55)),
        ("warning:count", F.abs(c("new_cluster_count") - c("old_cluster_count")) > 0.5 * c("old_cluster_count")),
    ]
    return diff.select(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules))).alias("risks"))
