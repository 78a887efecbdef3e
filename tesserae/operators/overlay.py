"""User edits over computed tables: moves, names, reviews; each a small table joined when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import basename, cluster_id


def upsert(log: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """The latest row of each key of an append-only log."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return log.withColumn("_n", latest).where("_n = 1").drop("_n")


def merge_fields(log: DataFrame, key: str, fields: list[str], seq: str = "seq") -> DataFrame:
    """The last value that is not null of each field: partial updates keep what they don't name."""
    return log.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields))


def _or(*names: Column) -> Column:
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def catalogue(analysis: DataFrame, names: DataFrame, summary: DataFrame, report: DataFrame, renames: DataFrame) -> DataFrame:
    """One row for each cluster that any of five tables knows.

    analysis (cluster_id, suggested_name, confidence), names (cluster_id,
    name), summary and report (cluster_id, name, count), renames (cluster_id,
    display_name).
    """
    key = "cluster_id"
    a = analysis.select(key, F.col("suggested_name").alias("a_name"), F.col("confidence"))
    n = names.select(key, F.col("name").alias("n_name"))
    s = summary.select(key, F.col("name").alias("s_name"), F.col("count").alias("s_count"))
    r = report.select(key, F.col("name").alias("r_name"), F.col("count").alias("r_count"))
    e = renames.select(key, F.col("display_name").alias("e_name"))
    every = a.join(n, key, "full").join(s, key, "full").join(r, key, "full").join(e, key, "full")
    default = F.when(F.col(key) == -1, "noise").otherwise(F.concat(F.lit("Cluster "), F.col(key)))
    suggested = _or(F.col("n_name"), F.col("a_name"))
    base = _or(F.col("a_name"), suggested, F.col("s_name"), F.col("r_name"))
    return every.select(
        key,
        F.coalesce(_or(F.col("e_name")), base, default).alias("display_name"),
        F.coalesce(suggested, base, default).alias("suggested_name"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("s_count", "r_count", F.lit(0)).alias("count"),
    )


def apply_moves(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` (image_path, filename, cluster_id) with original_cluster_id and the moved cluster_id.

    ``moves`` (alias, target and, for a log, seq): the path is looked up
    first, then the file name, then the path's last part.  Of several moves
    of one alias the last (by seq) counts; without seq that with the largest target.
    """
    out = rows.withColumn("original_cluster_id", cluster_id(F.col("cluster_id").cast("string")))
    keys = {"_m1": F.translate("image_path", "\\", "/"), "_m2": F.translate("filename", "\\", "/"), "_m3": basename(F.col("image_path"))}
    last = F.max_by("target", F.struct("seq", "target")) if "seq" in moves.columns else F.max("target")
    once = moves.groupBy("alias").agg(last.alias("target"))
    for name, key in keys.items():
        side = once.select(F.col("alias").alias(f"{name}_k"), F.col("target").alias(name))
        out = out.join(side, key == F.col(f"{name}_k"), "left").drop(f"{name}_k")
    return out.withColumn("cluster_id", F.coalesce("_m1", "_m2", "_m3", "original_cluster_id")).drop("_m1", "_m2", "_m3")


def with_names(moved: DataFrame, catalogue_: DataFrame) -> DataFrame:
    """Cluster names of the effective and the original cluster.

    A row that was not moved falls back to the name it came with.
    """
    own = F.nullif(F.col("_own"), F.lit("")) if "cluster_name" in moved.columns else F.lit(None).cast("string")
    moved = moved.withColumnRenamed("cluster_name", "_own")
    default = lambda c: F.when(F.col(c) == -1, "noise").otherwise(F.concat(F.lit("Cluster "), F.col(c)))
    for key, name in (("cluster_id", "cluster_name"), ("original_cluster_id", "original_cluster_name")):
        side = catalogue_.select(F.col("cluster_id").alias(key), F.col("display_name").alias(f"_{name}"))
        fallback = F.when(F.col(key) == F.col("original_cluster_id"), own)
        moved = moved.drop(name).join(side, key, "left").withColumn(name, F.coalesce(f"_{name}", fallback, default(key))).drop(f"_{name}")
    return moved.drop("_own")


def revert(moved: DataFrame) -> DataFrame:
    """Rows with their original clusters, for an export without moves."""
    return moved.withColumns({"cluster_id": F.col("original_cluster_id"), "cluster_name": F.col("original_cluster_name")})


def cluster_counts(rows: DataFrame, catalogue_: DataFrame, colors: int = 8) -> DataFrame:
    """cluster_id, display_name, count and colour number of every cluster that rows or the catalogue know."""
    counts = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    both = counts.join(catalogue_.select("cluster_id", "display_name"), "cluster_id", "full")
    default = F.when(F.col("cluster_id") == -1, "noise").otherwise(F.concat(F.lit("Cluster "), F.col("cluster_id")))
    return both.select("cluster_id", F.coalesce("display_name", default).alias("display_name"), F.coalesce("n", F.lit(0)).alias("count"), (F.abs("cluster_id") % colors).alias("color"))


def reviews(log: DataFrame) -> DataFrame:
    """The reviews a log of partial updates (image, flag, note, rating, seq) leaves; ratings within 0 and 5, unknown flags none."""
    now = merge_fields(log, "image", ["flag", "note", "rating"])
    flag = F.when(F.col("flag").isin("keep", "pick", "reject", "review", "favorite"), F.col("flag"))
    return now.select("image", flag.alias("flag"), "note", F.least(F.greatest("rating", F.lit(0)), F.lit(5)).alias("rating"))


def reviewed(rows: DataFrame, reviews_: DataFrame, flag: str | None = None) -> DataFrame:
    """Rows whose path or file name has a review (with a flag); two semi joins, since an OR join cannot hash."""
    wanted = (reviews_ if flag is None else reviews_.where(F.col("flag") == flag)).select(F.col("image").alias("_image"))
    by_name = rows.join(wanted, F.col("filename") == F.col("_image"), "left_semi")
    rest = rows.join(wanted, F.col("filename") == F.col("_image"), "left_anti")
    return by_name.unionAll(rest.join(wanted, basename(F.col("image_path")) == F.col("_image"), "left_semi"))


def resolve(ids: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """image_id and path by the first source (image_id, path) that knows the id."""
    every = None
    for k, s in enumerate(sources):
        part = s.select("image_id", "path", F.lit(k).alias("_p"))
        every = part if every is None else every.unionAll(part)
    first = every.groupBy("image_id").agg(F.min(F.struct("_p", "path")).alias("_f")).select("image_id", F.col("_f.path").alias("path"))
    return ids.join(first, "image_id", "left")
