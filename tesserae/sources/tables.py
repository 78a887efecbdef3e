"""Tables on disk: explicit schemas, fallback locations, normalised legacy fields, sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.scalars import image_id
from tesserae.sources.storage import exists

#: Fields that have held an image's path, the first that is there counts.
PATH_FIELDS = ("source_path", "original_path", "image_path", "path", "file", "src", "filename")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def read_table(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several parquet, JSON or CSV locations that exists; an empty table if none does."""
    path = first_existing(spark, paths)
    if path is None:
        return spark.createDataFrame([], schema)
    if re.search(r"\.csv$", path):
        return spark.read.schema(schema).option("header", True).csv(path)
    if re.search(r"\.jsonl?$", path):
        return spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)
    return spark.read.schema(schema).parquet(path)


def feature_columns(df: DataFrame) -> list[str]:
    """All columns but the file's name and its cluster."""
    return [c for c in df.columns if c not in ("filename", "cluster_id")]


def normalize_index(df: DataFrame, root: str | None = None) -> DataFrame:
    """image_id, source_path, relative_path, filename, width and height of an index with old or new field names."""
    path = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in PATH_FIELDS if c in df.columns))
    path = F.translate(path, "\\", "/")
    relative = path if root is None else F.regexp_replace(path, "^" + re.escape(root.rstrip("/") + "/"), "")
    size = [F.col(c).cast("int").alias(c) if c in df.columns else F.lit(None).cast("int").alias(c) for c in ("width", "height")]
    return df.where(path.isNotNull()).select(image_id(relative).alias("image_id"), path.alias("source_path"), relative.alias("relative_path"), F.element_at(F.split(path, "/"), -1).alias("filename"), *size)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header each; arrays are joined by ``;``."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def build_channel(spark: SparkSession, path: str, build, force: bool = False) -> tuple[DataFrame, str]:
    """The table at ``path``, built unless it is ready; and ``already_ready`` or ``built``."""
    ready = exists(spark, f"{path}/_SUCCESS")
    if not ready or force:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), "already_ready" if ready and not force else "built"


def manifest(spark: SparkSession, values: dict) -> DataFrame:
    """A one-row table of a job's settings."""
    return spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "manifest string")
