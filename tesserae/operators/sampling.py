"""Stratified sampling of an inventory of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import file_size_bucket, orientation, short_hash, size_bucket


@dataclass(frozen=True)
class Quota:
    max_total: int = 800
    max_per_root: int = 300
    max_per_leaf: int = 25
    min_per_leaf: int = 2
    max_file_size_mb: float = 50.0
    stress_large_per_root: int = 10
    seed: int = 42


def inventory(files: DataFrame, max_mb: float = 200.0) -> DataFrame:
    """Buckets and the reason to skip of each file (path, root_name, leaf_dir, extension, width, height, size_bytes)."""
    mb = F.col("size_bytes") / (1024 * 1024)
    readable = F.coalesce(F.col("width") > 0, F.lit(False))
    reason = F.when(F.col("size_bytes").isNull(), "stat_error").when(mb > max_mb, "too_large").when(~readable, "broken").otherwise("")
    return files.select(
        "*",
        mb.alias("file_size_mb"),
        readable.alias("readable"),
        reason.alias("skip_reason"),
        orientation(F.col("width"), F.col("height")).alias("orientation"),
        size_bucket(F.greatest("width", "height")).alias("size_bucket"),
        file_size_bucket(mb).alias("file_size_bucket"),
        short_hash(F.col("path")).alias("path_hash"),
    )


def split(records: DataFrame, quota: Quota = Quota()) -> DataFrame:
    """``records`` with part: healthy, stress, too_large or broken."""
    part = F.when(~F.col("readable"), "broken").when(F.contains("skip_reason", F.lit("too_large")), "too_large").when(F.col("file_size_mb") > quota.max_file_size_mb, "stress").otherwise("healthy")
    return records.withColumn("part", part)


def stratified(records: DataFrame, quota: Quota = Quota()) -> DataFrame:
    """Selected healthy records with sample_reason.

    A hash of path and seed takes the place of shuffling: the first
    ``min_per_leaf`` of each leaf, then up to ``max_per_leaf`` with
    orientations and extensions that the leaf's first ones lack in front; a
    root's and the total quota keep the leaf minima first.
    """
    order = F.md5(F.concat(F.lit(f"{quota.seed}:"), F.col("path")).cast("binary"))
    leaf = Window.partitionBy("root_name", "leaf_dir")
    rows = split(records, quota).where("part = 'healthy'").drop("part").withColumn("_h", order)
    rows = rows.withColumn("_n", F.row_number().over(leaf.orderBy("_h", "path")))
    first = F.col("_n") <= quota.min_per_leaf
    seen = lambda c: F.array_contains(F.collect_set(F.when(first, F.col(c))).over(leaf), F.col(c))
    rows = rows.withColumn("_score", F.when(first, 100).otherwise(F.when(seen("orientation"), 0).otherwise(10) + F.when(seen("extension"), 0).otherwise(5)))
    rows = rows.withColumn("_m", F.row_number().over(leaf.orderBy(F.desc("_score"), "_n"))).where(F.col("_m") <= quota.max_per_leaf)
    minimum = F.when(first, 0).otherwise(1)
    root = Window.partitionBy("root_name")
    rows = rows.withColumn("_r", F.row_number().over(root.orderBy(minimum, "_h", "path"))).withColumn("_size", F.count("*").over(root)).where(F.col("_r") <= quota.max_per_root)
    reason = F.when(first, "leaf_minimum").when(F.col("_size") > quota.max_per_root, "random_fill").otherwise("orientation_extension_balance")
    # at most max_per_root rows of a root are left; the last cut is a top-k
    out = rows.withColumn("sample_reason", reason).orderBy(minimum, "_h", "path").limit(quota.max_total)
    return out.drop("_h", "_n", "_score", "_m", "_r", "_size")


def stress(records: DataFrame, quota: Quota = Quota()) -> DataFrame:
    """The first large files of each root."""
    rows = split(records, quota).where("part = 'stress'").drop("part")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("root_name").orderBy("path"))).where(F.col("_n") <= quota.stress_large_per_root).drop("_n")


def selection_summary(selected: DataFrame, records: DataFrame, quota: Quota = Quota()) -> DataFrame:
    """Rows selected, stress and skipped rows by root."""
    parts = split(records, quota).groupBy("root_name").agg(F.count_if(F.col("part") == "stress").alias("stress"), F.count_if(F.col("part").isin("too_large", "broken")).alias("skipped"))
    chosen = selected.groupBy("root_name").agg(F.count("*").alias("selected"))
    return parts.join(chosen, "root_name", "left").select("root_name", F.coalesce("selected", F.lit(0)).alias("selected"), F.least("stress", F.lit(quota.stress_large_per_root)).alias("stress"), "skipped")
