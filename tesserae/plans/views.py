"""Image-like views of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import grams
from tesserae.functions.config import FEATURES
from tesserae.operators.graph import cut
from tesserae.operators.histogram import histogram

#: Histogram columns of the bank: the values they count, range and bins.
BANK = {"brightness_hist": ("v", -0.3, 0.3, 16), "saturation_hist": ("abs(v)", 0.0, 0.3, 16), "hue_hist": ("v", -0.3, 0.3, 24)}
#: The width of the hashes below, their names, and how many texts are taken from a batch at once.
HASH_BITS = 60
HASHES = ("phash", "dhash", "whash", "colorhash")
TEXTS_AT_ONCE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster_id (label 9 is noise) and the 16 features: means of four elements each."""
    e = F.col("embedding")
    cols = [(sum((F.get(e, F.lit(4 * i + k)).cast("double") for k in range(1, 4)), F.get(e, F.lit(4 * i)).cast("double")) / 4).alias(n) for i, n in enumerate(FEATURES)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int").alias("cluster_id"), *cols)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_path, source, hue_valid and the three histograms of each embedding."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", values.alias("v"))
    hists = [histogram(F.transform("v", F.abs) if of != "v" else F.col("v"), low, high, bins).alias(n) for n, (of, low, high, bins) in BANK.items()]
    return rows.select("vec_id", F.concat(F.lit("img/"), F.format_string("%06d", "vec_id")).alias("image_path"), F.concat(F.lit("s"), F.col("vec_id") % 5).alias("source"), (F.col("label") % 5 != 0).alias("hue_valid"), *hists)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_path and edge measures of each part, from its line items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.max("l_quantity").alias("q"))
    return items.select(
        F.concat(F.lit("part/"), F.col("l_partkey")).alias("image_path"),
        (F.col("p") / 50.031739).alias("blur_laplacian_var"),
        F.log1p(F.col("p") / 500).alias("sharpness_score"),
        (F.col("d") * 2.917331).alias("edge_density"),
        (F.col("t") * 1.031739).alias("local_contrast_p95"),
        F.col("q").alias("peak"),
    )


def part_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_path and three ratios of each part; small and large parts lack one of them."""
    bright = F.when(F.col("p_size") <= 40, F.col("p_size") / 50)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("image_path"), bright.alias("brightness_bright_ratio"), (1 - F.col("p_size") / 50).alias("brightness_dark_ratio"), F.when(F.col("p_size") > 10, F.col("p_size") % 10 / 10).alias("saturation_low_ratio"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_path and image measures of each part."""
    w, h = F.col("p_size") * 40, (F.col("p_partkey") % 50 + 1) * 40
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey")).alias("image_path"),
        w.cast("int").alias("width"),
        h.cast("int").alias("height"),
        F.round(w * h / 1e6, 4).alias("megapixels"),
        F.round(F.least(w, h) / F.greatest(w, h), 4).alias("aspect_ratio"),
        F.when(w > h, "landscape").when(w < h, "portrait").otherwise("square").alias("orientation"),
        F.round(F.col("p_retailprice") / 2500, 4).alias("overexposed_ratio"),
        F.round(F.col("p_partkey") % 97 / 100, 4).alias("underexposed_ratio"),
        F.round(F.col("p_partkey") % 13 / 20, 4).alias("transparent_ratio"),
    )


_FEATS = ", ".join(f"(embedding[{4 * i + 1}]::DOUBLE + embedding[{4 * i + 2}]::DOUBLE + embedding[{4 * i + 3}]::DOUBLE + embedding[{4 * i + 4}]::DOUBLE) / 4 AS {n}" for i, n in enumerate(FEATURES))
#: The sum's order differs from the view's (first element last), so compare rounded values.
FEATURES_SQL = f"SELECT vec_id, (CASE WHEN label = 9 THEN -1 ELSE label END)::INTEGER AS cluster_id, {_FEATS} FROM embeddings"


def _hist_sql(of: str, low: float, high: float, bins: int) -> str:
    inside = f"list_filter(list_transform(vals, lambda v: {of}), lambda v: v >= {low} AND v <= {high})"
    return f"list_transform(range({bins}), lambda b: len(list_filter({inside}, lambda v: least(floor((v - ({low})) / ({high} - ({low})) * {bins}), {bins - 1}) = b)) / greatest(len({inside}), 1)::DOUBLE)"


BANK_SQL = (
    "SELECT vec_id, 'img/' || lpad(vec_id::VARCHAR, 6, '0') AS image_path, 's' || (vec_id % 5) AS source, label % 5 <> 0 AS hue_valid, "
    + ", ".join(f"{_hist_sql(*spec)} AS {n}" for n, spec in BANK.items())
    + " FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS vals FROM embeddings)"
)
QUALITY_SQL = """SELECT 'part/' || l_partkey AS image_path, p / 50.031739::DOUBLE AS blur_laplacian_var, ln(1 + p / 500) AS sharpness_score,
d * 2.917331::DOUBLE AS edge_density, t * 1.031739::DOUBLE AS local_contrast_p95, q AS peak
FROM (SELECT l_partkey, avg(l_extendedprice) AS p, avg(l_discount) AS d, avg(l_tax) AS t, max(l_quantity) AS q FROM lineitem GROUP BY l_partkey)"""
PART_HISTOGRAM_SQL = "SELECT 'part/' || p_partkey AS image_path, CASE WHEN p_size <= 40 THEN p_size / 50.0::DOUBLE END AS brightness_bright_ratio, 1 - p_size / 50.0::DOUBLE AS brightness_dark_ratio, CASE WHEN p_size > 10 THEN (p_size % 10) / 10.0::DOUBLE END AS saturation_low_ratio FROM part"
METADATA_SQL = """SELECT 'part/' || p_partkey AS image_path, w::INTEGER AS width, h::INTEGER AS height, round(w * h / 1e6::DOUBLE, 4) AS megapixels,
round(least(w, h) / greatest(w, h)::DOUBLE, 4) AS aspect_ratio, CASE WHEN w > h THEN 'landscape' WHEN w < h THEN 'portrait' ELSE 'square' END AS orientation,
round(p_retailprice / 2500, 4) AS overexposed_ratio, round(p_partkey % 97 / 100.0::DOUBLE, 4) AS underexposed_ratio, round(p_partkey % 13 / 20.0::DOUBLE, 4) AS transparent_ratio
FROM (SELECT *, p_size * 40 AS w, (p_partkey % 50 + 1) * 40 AS h FROM part)"""


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b["texts"].flatten().cast(pa.large_binary())
        row = np.repeat(np.arange(len(b)), b["texts"].value_lengths().to_numpy())
        words, pairs = grams.Majorities(len(b)), grams.Majorities(len(b))
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            grams.count(texts[k : k + TEXTS_AT_ONCE].to_pylist(), row[k : k + TEXTS_AT_ONCE], words, pairs)
        values = [pa.array(v, mask=of.n == 0) for of in (words, pairs) for v in of.hashes(HASH_BITS)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *values], names=["id", *HASHES]).filter(pa.array(words.n > 0))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and four 60-bit similarity hashes of each document: of words and of word pairs, two of each.

    A document's digests are made and counted in its row, so no word is
    shuffled; only the texts of an id that several rows have are joined first.
    """
    docs = table(spark, sf_dir, "documents")
    rows = docs.where("text IS NOT NULL").select("doc_id", F.array(F.lower("text")).alias("texts"))
    repeated = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not repeated.isEmpty():
        same = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("texts")).alias("texts"))
        rows = rows.join(repeated, "doc_id", "left_anti").unionAll(same)
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_hashed, ", ".join([f"id {kind}", *(f"{n} long" for n in HASHES)]))


def _hash_sql(name: str, grams: str, k: int) -> str:
    value = " + ".join(f"CASE WHEN sum(((h >> {b}) & 1) * 2 - 1) > 0 THEN {1 << b} ELSE 0 END" for b in range(60))
    return f"{name} AS (SELECT doc_id, ({value})::BIGINT AS {name} FROM (SELECT doc_id, ('0x' || substr(md5(g), {k}, 15))::BIGINT AS h FROM (SELECT doc_id, unnest(list_distinct({grams})) AS g FROM words)) GROUP BY doc_id)"


HASHES_CTE = (
    "words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), "
    + ", ".join(_hash_sql(n, g, k) for n, g, k in (("phash", "w", 1), ("dhash", "w", 17), ("whash", "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])", 1), ("colorhash", "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])", 17)))
    + ", hashes AS (SELECT doc_id AS id, phash, dhash, whash, colorhash FROM phash JOIN dhash USING (doc_id) LEFT JOIN whash USING (doc_id) LEFT JOIN colorhash USING (doc_id))"
)
