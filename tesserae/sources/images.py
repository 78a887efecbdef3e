"""Image files: scans, decoding, and the tables that one decoding pass gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import kernels
from tesserae.functions.config import FEATURE_GROUPS
from tesserae.functions.scalars import basename, extension, image_id, stem
from tesserae.sources.storage import exists

# What counts as an image.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
MIN_BYTES = 100


def scan(spark: SparkSession, folders: list[str], recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """path, filename, extension, length and modificationTime of image files, each path once, by path.

    Missing folders are left out; contents are not read.
    """
    there = [f for f in folders if exists(spark, f)]
    schema = "path string, modificationTime timestamp, length long"
    files = spark.createDataFrame([], schema)
    if there:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(there).select("path", "modificationTime", "length")
    files = files.withColumns({"filename": basename(F.col("path")), "extension": extension(F.col("path"))})
    return files.where(F.col("extension").isin(*extensions) & (F.col("length") >= min_bytes)).dropDuplicates(["path"]).orderBy("path")


def probe(files: DataFrame, samples: int = 5) -> tuple[DataFrame, list[str]]:
    """Files by extension, and the first few names."""
    return files.groupBy("extension").agg(F.count("*").alias("count")), [r["filename"] for r in files.orderBy("path").limit(samples).collect()]


def read(spark: SparkSession, folders: list[str], recursive: bool = True) -> DataFrame:
    """path, width, height, nChannels and data (B, G, R rows) of images; a width of -1 where one cannot be decoded."""
    df = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive).load(folders)
    return df.select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.data")


def read_paths(spark: SparkSession, paths: DataFrame, block: int = 10_000) -> DataFrame:
    """The same for the images that rows (path) name; the driver lists them by blocks, as it lists the files of a folder."""
    names = [r["path"] for r in paths.select("path").toLocalIterator()]
    blocks = [read(spark, names[k : k + block]) for k in range(0, len(names), block)]
    none = spark.createDataFrame([], "path string, width int, height int, nChannels int, data binary")
    return reduce(DataFrame.unionByName, blocks, none)


def _split(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """RGB from 0 to 1, and alpha where there is one, of B, G, R (and alpha) or grey bytes."""
    raw, channels = raw / 255.0, raw.shape[-1]
    if channels == 1:
        return np.repeat(raw, 3, axis=-1), None
    return np.ascontiguousarray(raw[..., 2::-1]) if channels == 3 else raw[..., [2, 1, 0]], raw[..., 3] if channels == 4 else None


def pixels(width: int, height: int, channels: int, data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """RGB from 0 to 1, and alpha where there is one."""
    return _split(np.frombuffer(data, np.uint8).reshape(height, width, channels))


# Fixed value: pixels that are measured at once; a larger image is a stack of its own.
STACK = 1 << 16


def stacks(batch: pd.DataFrame) -> Iterator[tuple[list[int], np.ndarray, np.ndarray | None]]:
    """Row numbers, RGB and alpha of the images of a batch, by size and at most STACK pixels (or one image) at once."""
    by_size: dict[tuple, list[int]] = {}
    for k, size in enumerate(zip(batch["width"], batch["height"], batch["nChannels"], strict=True)):
        by_size.setdefault(size, []).append(k)
    for size, rows in by_size.items():
        w, h, c = map(int, size)
        step = max(1, STACK // (w * h))
        for a in range(0, len(rows), step):
            at = rows[a : a + step]
            raw = np.stack([np.frombuffer(batch["data"].iat[k], np.uint8).reshape(h, w, c) for k in at])
            yield at, *_split(raw)


def decoded(images: DataFrame, compute: Callable[[np.ndarray, np.ndarray | None], dict], schema: str, most: int | None = None) -> DataFrame:
    """path, the fields of ``compute`` for each image, and error (null where it could be decoded).

    ``compute`` gets stacks of images of one size and gives a value for each of them in every field.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = batch["data"].map(lambda d: d is not None and len(d) > 0).astype(bool) & (batch["width"] > 0)
            bad = batch["path"][~good]
            yield pd.DataFrame({"path": bad} | {n: pd.Series([None] * len(bad), bad.index, object) for n in names} | {"error": "cannot decode"})
            for part, rgb, alpha in stacks(some := batch[good]):
                if most and max(rgb.shape[1:3]) > most:
                    rgb = np.stack([kernels.shrink(one, most) for one in rgb])
                found = compute(rgb, alpha)
                yield pd.DataFrame({"path": some["path"].iloc[part].to_numpy()} | {n: list(v) if np.ndim(v := found[n]) > 1 else v for n in names} | {"error": None})

    return images.select("path", "width", "height", "nChannels", "data").mapInPandas(run, f"path string, {schema}, error string")


def one_by_one(compute: Callable[[np.ndarray], dict]) -> Callable[[np.ndarray, np.ndarray | None], dict]:
    """A function of one image as one of stacks."""

    def run(rgb: np.ndarray, alpha: np.ndarray | None) -> dict:
        found = [compute(one) for one in rgb]
        return {n: [f[n] for f in found] for n in found[0]}

    return run


def with_ids(table: DataFrame, root: str | None = None) -> DataFrame:
    """image_id and image_path in place of the path."""
    path = F.regexp_replace("path", "^file:/+", "/")
    relative = path if root is None else F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
    return table.select(image_id(relative).alias("image_id"), relative.alias("image_path"), *(c for c in table.columns if c != "path"))


def split_errors(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that could be decoded, and path and reason of the others."""
    return table.where("error IS NULL").drop("error"), table.where("error IS NOT NULL").select("path", F.col("error").alias("reason"))


def feature_table(images: DataFrame, groups: dict[str, tuple[str, ...]] = FEATURE_GROUPS, weights: dict[str, float] | None = None, most: int = 1024) -> DataFrame:
    """The features of the groups, in order, each group cut to its names and weighted."""
    names = [n for g in groups.values() for n in g]

    def compute(rgb: np.ndarray, alpha: np.ndarray | None) -> dict:
        values = [v * (weights or {}).get(g, 1.0) for g, fs in groups.items() for v in kernels.EXTRACTORS[g](rgb)[: len(fs)]]
        return dict(zip(names, values, strict=True))

    return decoded(images, compute, ", ".join(f"{n} double" for n in names), most)


def histogram_bank(images: DataFrame, most: int = 512) -> DataFrame:
    return decoded(images, lambda rgb, alpha: kernels.histograms(rgb), "brightness_hist array<double>, saturation_hist array<double>, hue_hist array<double>, hue_valid boolean", most)


SHAPE = "dark double, mid double, bright double, entropy double, peak int"
METADATA = "width int, height int, megapixels double, short_side int, long_side int, aspect_ratio double, orientation string, has_alpha boolean, transparent_ratio double, overexposed_ratio double, underexposed_ratio double, clipping_ratio double"


def brightness_shapes(images: DataFrame) -> DataFrame:
    return decoded(images, lambda rgb, alpha: kernels.brightness_shape(rgb), SHAPE)


def shapes_and_metadata(images: DataFrame) -> DataFrame:
    """Brightness shapes beside the metadata, of one decoding."""
    return decoded(images, lambda rgb, alpha: kernels.brightness_shape(rgb) | kernels.metadata(rgb, alpha), f"{SHAPE}, {METADATA}")


def quality_table(images: DataFrame, most: int = 512) -> DataFrame:
    names = ("blur_laplacian_var", "sharpness_score", "edge_density", "edge_mean", "edge_p95", "local_contrast_mean", "local_contrast_p95", "hue_coverage", "hue_concentration")
    return decoded(images, lambda rgb, alpha: kernels.quality(rgb), ", ".join(f"{n} double" for n in names), most)


def metadata_table(images: DataFrame) -> DataFrame:
    return decoded(images, kernels.metadata, METADATA)


def hash_table(images: DataFrame) -> DataFrame:
    return decoded(images, one_by_one(lambda rgb: {n: f(rgb) for n, f in kernels.HASHES.items()}), ", ".join(f"{n} long" for n in kernels.HASHES), 256)


def legacy_table(images: DataFrame, most: int = 1024) -> DataFrame:
    return decoded(images, one_by_one(lambda rgb: {"features": kernels.legacy_vector(rgb)}), "features array<double>", most)


def depth_pairs(images: DataFrame, depths: DataFrame) -> DataFrame:
    """Depth features and coupling of images with a file ``<stem>_depth`` among ``depths``."""
    key = F.regexp_replace(stem(F.col("path")), "_depth$", "")
    side = depths.select(key.alias("_k"), *(F.col(c).alias(f"d_{c}") for c in ("width", "height", "nChannels", "data")))
    joined = images.withColumn("_k", stem(F.col("path"))).join(side, "_k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                rgb, _ = pixels(r.width, r.height, r.nChannels, r.data)
                far, _ = pixels(r.d_width, r.d_height, r.d_nChannels, r.d_data)
                depth = kernels.area_resize(kernels.luma(far), *rgb.shape[:2])
                rows.append((r.path, *map(float, kernels.depth_features(depth)), *kernels.coupling(rgb, depth)))
            yield pd.DataFrame(rows, columns=["path", "depth_mean", "depth_variance", "depth_confidence", "gradient_correlation", "edge_depth_variance"])

    cols = joined.where("width > 0 AND d_width > 0").select("path", "width", "height", "nChannels", "data", "d_width", "d_height", "d_nChannels", "d_data")
    return cols.mapInPandas(run, "path string, depth_mean double, depth_variance double, depth_confidence double, gradient_correlation double, edge_depth_variance double")
