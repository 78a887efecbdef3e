"""Slices: named orders over a channel, filters, paging, and the algebra of lists of ids."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import labels
from tesserae.operators.graph import cut


@dataclass(frozen=True)
class Slice:
    """The first rows of a channel in the order of a field; ``where`` is an SQL filter."""

    name: str
    channel: str
    field: str
    descending: bool = True
    where: str | None = None
    limit: int = 100


# The catalogue of slices by channel, field and direction.
CATALOGUE = {
    s.name: s
    for s in (
        Slice("all", "basic_metadata", "megapixels"),
        Slice("low_brightness", "histogram", "brightness_dark_ratio"),
        Slice("medium_brightness", "histogram", "brightness_entropy"),
        Slice("high_brightness", "histogram", "brightness_bright_ratio"),
        Slice("high_contrast", "histogram", "brightness_entropy"),
        Slice("flat_light", "histogram", "brightness_entropy", False),
        Slice("strong_highlight", "histogram", "brightness_bright_ratio"),
        Slice("dark_shadow", "histogram", "brightness_dark_ratio"),
        Slice("red_theme", "histogram", "hue_warm_ratio"),
        Slice("orange_yellow_theme", "histogram", "hue_warm_ratio"),
        Slice("green_theme", "histogram", "hue_cool_ratio"),
        Slice("blue_cyan_theme", "histogram", "hue_cool_ratio"),
        Slice("purple_theme", "histogram", "hue_cool_ratio"),
        Slice("warm_tone", "histogram", "hue_warm_ratio"),
        Slice("cool_tone", "histogram", "hue_cool_ratio"),
        Slice("low_saturation", "histogram", "saturation_low_ratio"),
        Slice("high_saturation", "histogram", "saturation_high_ratio"),
        Slice("blur_suspect", "quality_edge", "blur_laplacian_var", False),
        Slice("sharp_image", "quality_edge", "sharpness_score"),
        Slice("line_art_candidate", "quality_edge", "lineart_score_v2"),
        Slice("flat_color_candidate", "quality_edge", "flat_color_score"),
        Slice("high_edge_density", "quality_edge", "edge_density"),
        Slice("low_detail_image", "quality_edge", "edge_density", False),
        Slice("large_image", "basic_metadata", "megapixels"),
        Slice("small_image", "basic_metadata", "megapixels", False),
        Slice("portrait_image", "basic_metadata", "aspect_ratio", False, "orientation = 'portrait'"),
        Slice("landscape_image", "basic_metadata", "aspect_ratio", True, "orientation = 'landscape'"),
        Slice("square_image", "basic_metadata", "aspect_ratio", False, "aspect_ratio BETWEEN 0.9 AND 1.1"),
        Slice("transparent_image", "basic_metadata", "transparent_ratio"),
        Slice("overexposed_suspect", "basic_metadata", "overexposed_ratio"),
        Slice("underexposed_suspect", "basic_metadata", "underexposed_ratio"),
    )
}


def order(field: str, descending: bool, key: str) -> list[Column]:
    """Missing values last, ties by key."""
    return [F.desc_nulls_last(field) if descending else F.asc_nulls_last(field), F.asc(key)]


def take(channel: DataFrame, slice_: Slice, key: str = "image_path") -> DataFrame:
    """A slice's rows with their rank; top-k per task, so nothing is sorted as a whole."""
    rows = channel if slice_.where is None else channel.where(slice_.where)
    top = rows.orderBy(*order(slice_.field, slice_.descending, key)).limit(slice_.limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order(slice_.field, slice_.descending, key))))


def take_all(channel: DataFrame, slices_: Iterable[Slice], key: str = "image_path") -> DataFrame:
    """slice, rank and key of several slices of one channel; slices with the same rows are taken once.

    Each takes its own columns of the channel only, so give a stored one.
    """
    names: dict[Slice, list[str]] = {}
    for s in slices_:
        names.setdefault(replace(s, name=""), []).append(s.name)
    parts = [take(channel, s, key).select(F.explode(F.array(*map(F.lit, of))).alias("slice"), F.col("rank").cast("long").alias("rank"), key) for s, of in names.items()]
    return reduce(DataFrame.unionAll, parts)


def available(slice_: Slice, columns: list[str]) -> bool:
    """Whether a built channel has what a slice needs."""
    return slice_.field in columns


def page(channel: DataFrame, allowed: set[str], sort_by: str, descending: bool = True, label: str | None = None, strict: bool = True, limit: int = 100, offset: int = 0, most: int = 1000, key: str = "image_path", fallback: bool = False) -> tuple[DataFrame, int]:
    """A page of a channel and the number of rows before paging.

    A field outside ``allowed`` raises, or sorts by ``key`` alone where ``fallback`` asks for that.
    """
    if sort_by not in allowed:
        if not fallback:
            raise ValueError(f"cannot sort by {sort_by!r}")
        sort_by, descending = key, False
    rows = channel if label is None else channel.where(labels.has_label(F.col("labels"), label, strict))
    return rows.orderBy(*order(sort_by, descending, key)).offset(offset).limit(min(limit, most)), rows.count()


def viewport(points: DataFrame, x0: float, x1: float, y0: float, y1: float, x: str = "umap_x", y: str = "umap_y") -> DataFrame:
    """Points inside a box, edges included."""
    return points.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def first_occurrences(items: DataFrame, key: str, *position: str) -> DataFrame:
    """The first row of each key in the order of ``position``."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*position))
    return items.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def intersect_all(lists: DataFrame, n_lists: int, by: str = "average_rank", primary: str | None = None) -> DataFrame:
    """Ids (image_id) that are in all of ``n_lists`` lists (list_id, image_id, rank), with their order.

    ``average_rank`` orders by the mean rank over the lists, ``primary`` by
    the rank in the list of that name.
    """
    first = lists.groupBy("list_id", "image_id").agg(F.min("rank").alias("rank"))
    every = first.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("rank").alias("average_rank"), F.min(F.when(F.col("list_id") == primary, F.col("rank"))).alias("primary_rank"))
    every = every.where(F.col("n") == n_lists)
    return every.select("image_id", F.col("average_rank" if by == "average_rank" else "primary_rank").alias("order_value"))


def combine(primary: DataFrame, others: list[DataFrame], top: int | None = None, key: str = "image_id", rank: str = "rank") -> DataFrame:
    """Rows of the primary list that all other lists hold, in its order."""
    for other in others:
        primary = primary.join(other.select(key).distinct(), key, "left_semi")
    return primary if top is None else primary.orderBy(rank, key).limit(top)


def toggle(selected: DataFrame, clicked: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids in exactly one of two selections."""
    both = selected.select(key).distinct().withColumn("_n", F.lit(1)).unionAll(clicked.select(key).distinct().withColumn("_n", F.lit(1)))
    return both.groupBy(key).agg(F.sum("_n").alias("_n")).where("_n = 1").select(key)


def union_ids(*lists: DataFrame, key: str = "image_id") -> DataFrame:
    out = lists[0].select(key)
    for other in lists[1:]:
        out = out.union(other.select(key))
    return out.distinct()


def ranked(rows: DataFrame, *by: str, name: str = "rank", kind: str = "int") -> DataFrame:
    """``rows`` with their place from 1 in a total order, without bringing them into one task.

    A range-partitioned sort numbers the rows of each part; the parts' sizes
    (one number a part) give the offsets.
    """
    ordered = cut(rows.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    start, offsets = 0, []
    for r in sizes:
        offsets += [F.lit(r["part"]), F.lit(start).cast("long")]
        start += r["n"]
    if not offsets:
        return ordered.withColumn(name, F.lit(0).cast(kind)).drop("_at")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn(name, (F.create_map(*offsets)[part] + within + 1).cast(kind)).drop("_at")


def ranked_within(rows: DataFrame, groups: list[str], *by: str, name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 within their group, in a total order; a group of any size spreads over tasks.

    All rows are numbered at once, by group; the number of a group's first row
    is taken off.  Nulls are a group.
    """
    numbered = ranked(rows, *groups, *by, name="_all", kind="long")
    first = numbered.groupBy(*groups).agg(F.min("_all").alias("_first"))
    first = first.select("_first", *(F.col(g).alias(f"_of_{g}") for g in groups))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups))
    return numbered.join(first, same).withColumn(name, (F.col("_all") - F.col("_first") + 1).cast("int")).drop("_all", "_first", *(f"_of_{g}" for g in groups))


def flatten_cart(cart: DataFrame) -> DataFrame:
    """Ids of cart items (item, image_ids, top_n) in order, each kept in the first item that has it."""
    rows = cart.select("item", F.posexplode(F.when(F.col("top_n").isNull(), F.col("image_ids")).otherwise(F.slice("image_ids", F.lit(1), F.col("top_n")))).alias("pos", "image_id"))
    return first_occurrences(rows, "image_id", "item", "pos")


def manual_order(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """``rows`` (cluster_id, filename) with the position in a saved order (cluster_id, files); 999 where it has none."""
    at = orders.select("cluster_id", F.posexplode("files").alias("position", "filename")).groupBy("cluster_id", "filename").agg(F.min("position").alias("position"))
    return rows.join(at, ["cluster_id", "filename"], "left").withColumn("position", F.coalesce("position", F.lit(999)))
