"""Export plans: which files go where, under what names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import basename, extension, rename, sanitize_filename, stem
from tesserae.operators.slices import first_occurrences, ranked, ranked_within


def plan(items: DataFrame, folder: str, template: str | None = None, top: int | None = None) -> DataFrame:
    """rank, image_id, path and target of an ordered list (image_id, path, position), each id once.

    Without a template files keep their names; a name that a folder holds
    already gets ``_1``, ``_2`` and so on.
    """
    rows = first_occurrences(items, "image_id", "position")
    if top is not None:
        rows = rows.orderBy("position", "image_id").limit(top)
    rows = ranked(rows, "position", "image_id")
    name = basename(F.col("path")) if template is None else rename(template, F.lit(folder), F.col("rank"), F.col("path"))
    return _unique(rows.withColumn("_name", sanitize_filename(name)).withColumn("_folder", F.lit(folder)))


def by_cluster(rows: DataFrame) -> DataFrame:
    """The same with a folder for each cluster, named after it; rows have image_id, path, cluster_id, cluster_name, position."""
    folder = F.concat(F.when(F.col("cluster_id") < 0, "noise").otherwise(F.format_string("cluster_%03d", F.col("cluster_id"))), F.lit("_"), F.substring(sanitize_filename(F.col("cluster_name")), 1, 80))
    numbered = ranked_within(rows, ["cluster_id"], "position", "image_id")
    return _unique(numbered.withColumn("_name", sanitize_filename(basename(F.col("path")))).withColumn("_folder", folder))


def _unique(rows: DataFrame) -> DataFrame:
    rows = ranked_within(rows, ["_folder", "_name"], "rank", "image_id", name="_nth")
    nth = F.col("_nth") - 1
    name = F.when(nth == 0, F.col("_name")).otherwise(F.concat(stem(F.col("_name")), F.lit("_"), nth, extension(F.col("_name"))))
    return rows.select("rank", "image_id", "path", F.concat(F.col("_folder"), F.lit("/"), name).alias("target"))


def select(rows: DataFrame, kind: str, clusters: list[int] | None = None, reviews: DataFrame | None = None, flag: str | None = None) -> DataFrame:
    """Rows of an export: ``by_cluster``, ``by_review`` (a flag or any), else all."""
    from tesserae.operators.overlay import reviewed

    if kind == "by_cluster":
        return rows.where(F.col("cluster_id").isin(clusters or []))
    if kind == "by_review" and reviews is not None:
        return reviewed(rows, reviews, flag)
    return rows


def normal_path(path: Column) -> Column:
    """A path with ``/`` separators, without ``.`` and with ``..`` resolved; one that climbs above its start keeps ``..`` in front."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1))) != "..")
        return F.when(F.size(done) == 0, F.array(part)).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(parts, none, step), "/"))


def contained(path: Column, roots: list[str]) -> Column:
    """Whether a path lies inside one of the roots once ``..`` is resolved; false for null."""
    normal = normal_path(path)
    inside = [F.startswith(normal, F.concat(normal_path(F.lit(r)), F.lit("/"))) for r in roots]
    return F.coalesce(reduce(lambda a, b: a | b, inside, F.lit(False)), F.lit(False))
