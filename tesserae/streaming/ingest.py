"""New image files as a stream: each content once, rates by window of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.scalars import basename, extension
from tesserae.sources.images import EXTENSIONS, MIN_BYTES

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, filename, modificationTime, length and content hash of image files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    files = files.where(extension(F.col("path")).isin(*EXTENSIONS) & (F.col("length") >= MIN_BYTES))
    return files.select("path", basename(F.col("path")).alias("filename"), "modificationTime", "length", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def distinct_contents(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The first file of each content; state is dropped after the watermark."""
    return stream.withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["content_hash"])


def rates(stream: DataFrame, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Files and bytes by window of modification time; late files count until the watermark."""
    return stream.withWatermark("modificationTime", watermark).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Write what there is to parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
