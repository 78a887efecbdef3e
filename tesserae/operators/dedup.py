"""Duplicate groups: exact ones by content hashes, perceptual ones by Hamming distances of several hashes.

The joins of the perceptual ones merge, so that no table that grows with the input is sent by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import components, cut
from tesserae.operators.overlay import merge_fields
from tesserae.sources.storage import written

# The largest distance that counts as a hit, by hash, and the hits a pair needs.
THRESHOLDS = {"phash": 6, "dhash": 8, "whash": 8, "colorhash": 4}
MIN_HITS = 2
# How many bits the kernels' hashes have.
WIDTHS = {"phash": 64, "dhash": 64, "whash": 64, "colorhash": 42}
# Bits of a band by which rows meet in a unit, rows of a unit's side, pairs compared at once, and up to which runs are compared together.
UNIT_BITS, SIDE, AT_ONCE, SMALL = 6, 50_000, 1 << 16, 1 << 12


def exact_groups(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, file_size, sha256, group_id (the representative: the first path) and image_count of files with equal content.

    Only path, size and hashes are shuffled, not contents, which are read once;
    copies combine in counts.  Groups are written before the join back: an aggregate
    over the join's key would keep a large group in one task, a table lets the
    join split it.  Files without content are in no group.
    """
    raw = F.col(content).cast("binary")
    hashed = files.where(raw.isNotNull()).select(F.col(path).alias("path"), F.octet_length(raw).alias("file_size"), F.sha2(raw, 256).alias("sha256"), F.xxhash64(raw).alias("_x"))
    hashed = written(hashed, "hashes")
    key = ["file_size", "sha256", "_x"]
    groups = written(hashed.groupBy(*key).agg(F.min("path").alias("group_id"), F.count("*").alias("image_count")).where("image_count > 1"), "groups")
    return hashed.join(groups, key).drop("_x")


def _edges(n: int, bits: int) -> list[tuple[int, int]]:
    """Where each of ``n`` disjoint parts of a value of ``bits`` bits begins and how wide it is."""
    at = [k * bits // n for k in range(n + 1)]
    return [(x, y - x) for x, y in zip(at, at[1:], strict=False)]


@dataclass(frozen=True)
class PairRule:
    """Which hashes count, up to what distance, and how many of them a pair needs.

    ``bits`` is the width of every hash; without it, the kernels' own widths hold (64 for an unknown hash).
    """

    thresholds: tuple[tuple[str, int], ...] = tuple(THRESHOLDS.items())
    min_hits: int = MIN_HITS
    bits: int | None = None

    def width(self, name: str) -> int:
        return self.bits or WIDTHS.get(name, 64)

    def ways(self) -> list[tuple[str, int]]:
        """The tightest hashes, of which every pair with enough hits hits one."""
        tight = sorted(reversed(self.thresholds), key=lambda x: x[1])
        return tight[: len(tight) - self.min_hits + 1]


def _met(value: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``left`` and ``right`` (or two rows of ``left``) with equal keys whose values differ in ``most`` bits at most, in bounded blocks."""
    sides = [s[np.argsort(key[s], kind="stable")] for s in ((left,) if right is None else (left, right))]
    runs = [np.unique(key[s], return_index=True, return_counts=True) for s in sides]
    _, p, q = np.intersect1d(runs[0][0], runs[-1][0], assume_unique=True, return_indices=True)
    x, nx, y, ny = runs[0][1][p], runs[0][2][p], runs[-1][1][q], runs[-1][2][q]
    if right is None:
        x, nx, y, ny = (c[nx > 1] for c in (x, nx, y, ny))
    left, right = sides[0], sides[-1]
    alone = len(sides) == 1
    small = nx * ny <= SMALL
    total = np.cumsum(nx[small] * ny[small])
    done, low = 0, 0
    while low < len(total):  # all pairs of many short runs at once
        high = np.searchsorted(total, done + AT_ONCE, "right")
        some = slice(low, max(high, low + 1))
        sx, sy, nr, cells = x[small][some], y[small][some], ny[small][some], (nx * ny)[small][some]
        k = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        nr = np.repeat(nr, cells)
        u, v = np.repeat(sx, cells) + k // nr, np.repeat(sy, cells) + k % nr
        if alone:
            u, v = u[u < v], v[u < v]
        u, v = left[u], right[v]
        near = np.bitwise_count(value[u] ^ value[v]) <= most
        yield u[near], v[near]
        low, done = some.stop, total[some.stop - 1]
    for sx, n, sy, m in zip(x[~small], nx[~small], y[~small], ny[~small], strict=True):
        step = max(1, AT_ONCE // m)
        for k in range(0, n, step):
            skip = k if alone else 0
            us, vs = left[sx + k : sx + min(n, k + step)], right[sy + skip : sy + m]
            at = np.flatnonzero(np.bitwise_count(value[us][:, None] ^ value[vs][None, :]) <= most)
            u, v = at // len(vs), at % len(vs)
            if alone:
                u, v = u[u < v], v[u < v]
            yield us[u], vs[v]


def _in_bulk(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer blocks."""
    held, n = [], 0
    for x, y in blocks:
        if len(x):
            held.append((x, y))
            n += len(x)
        if n >= AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest rows of the trees that ``root`` tells, after rows x and y are joined."""
    while True:
        apart = root[x] != root[y]
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]


def _unit_pairs(rule: PairRule, links: bool):
    """A function that gives the pairs of a unit: rows whose band ``band`` of the hash ``way`` ends in the same bits, of one chunk or of two.

    With ``links``, it gives a row's pair with the first of those that pairs of the unit connect, with the least distances among these.

    Two hashes within a distance of t have two equal ones of t + 2 bands; a pair
    is kept by its first hash that hits, where these are its first two equal bands.
    """
    names, ways = [n for n, _ in rule.thresholds], rule.ways()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = pd.concat(batches, ignore_index=True)
        way, band, a, b = unit.loc[0, ["way", "band", "a", "b"]].astype(int)
        hashes, has = {n: unit[n].to_numpy(np.int64).view(np.uint64) for n in names}, {n: unit[f"has_{n}"].to_numpy(bool) for n in names}
        distance = lambda n, x, y: np.where(has[n][x] & has[n][y], np.bitwise_count(hashes[n][x] ^ hashes[n][y]).astype(np.int32), 999)
        own, ids = unit["own"].to_numpy(), unit["id"]
        left, right = np.flatnonzero(own == a), None if a == b else np.flatnonzero(own == b)
        name, t = ways[way]
        value = hashes[name]
        masks = [np.uint64(((1 << w) - 1) << at) for at, w in _edges(t + 2, rule.width(name))]
        root, least = np.arange(len(unit)), {n: np.full(len(unit), 999, np.int32) for n in names}
        for other in range(band + 1, t + 2):
            for x, y in _in_bulk(_met(value, value & (masks[band] | masks[other]), left, right, t)):
                turned = value[x] ^ value[y]
                first = np.logical_and.reduce([turned & masks[m] != 0 for m in range(other) if m != band] + [distance(n, x, y) > most for n, most in ways[:way]], axis=0) if other > 1 or way else np.ones(len(x), bool)
                x, y = x[first], y[first]
                d = {n: distance(n, x, y) for n in names}
                hits = sum((d[n] <= most).astype(np.int32) for n, most in rule.thresholds)
                enough = hits >= rule.min_hits
                x, y = x[enough], y[enough]
                if links:
                    root = _united(root, x, y)
                    for n in names:
                        np.minimum.at(least[n], x, d[n][enough])
                else:
                    yield pd.DataFrame({"a": ids.take(x).array, "b": ids.take(y).array} | {f"d_{n}": d[n][enough] for n in names} | {"hits": hits[enough]})
        if links:
            for n in names:
                np.minimum.at(least[n], root, least[n].copy())
            y = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"a": ids.take(root[y]).array, "b": ids.take(y).array} | {f"d_{n}": least[n][root[y]] for n in names})

    return pairs


def hash_classes(hashes: DataFrame, rule: PairRule) -> DataFrame:
    """One row for each distinct tuple of hashes, with the first id that has it (id, hashes, copies)."""
    names = [n for n, _ in rule.thresholds]
    return hashes.groupBy(*names).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def near_pairs(classes: DataFrame, rule: PairRule = PairRule()) -> DataFrame:
    """Pairs a < b of classes with enough hits: the distances d_{hash} (999 for a missing hash) and hits.

    Rows meet in units by six bits of a band of one of the rule's ways (the
    pigeonhole principle makes that exact), and are joined there by a second
    equal band as arrays.  Units with more than ``SIDE`` rows are dealt as pairs of chunks.
    """
    return _near(classes, rule, False)


def near_links(classes: DataFrame, rule: PairRule = PairRule()) -> DataFrame:
    """Pairs a < b that connect the same classes as :func:`near_pairs`, but no more than one for each row of a unit.

    d_{hash} are the least distances of the pairs in the unit that a link stands
    for, so the number of links doesn't grow with the square of a group.
    """
    return _near(classes, rule, True)


def _near(classes: DataFrame, rule: PairRule, links: bool) -> DataFrame:
    names = [n for n, _ in rule.thresholds]
    classes = cut(classes)  # read for the sizes of units, too
    bands = [(way, band, name, at, min(w, UNIT_BITS)) for way, (name, t) in enumerate(rule.ways()) for band, (at, w) in enumerate(_edges(t + 2, rule.width(name))[: t + 1])]
    unit = lambda way, band, name, at, w, n: F.when(F.col(name).isNotNull(), F.struct(F.lit(way).alias("way"), F.lit(band).alias("band"), F.shiftrightunsigned(name, at).bitwiseAND(F.lit((1 << w) - 1)).alias("v"), F.lit(n).alias("n")))
    units = lambda n: F.inline(F.array_compact(F.array(*(unit(*x, n.get(x[:2], 1)) for x in bands))))
    sizes = classes.select(units({})).groupBy("way", "band", "v").count().groupBy("way", "band").agg(F.max("count").alias("most")).collect()
    there = classes.select("id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names), *(F.col(n).isNotNull().alias(f"has_{n}") for n in names), units({(r.way, r.band): -(-r.most // SIDE) for r in sizes}))
    dealt = there.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = ["way", "band", "v", "a", "b"]
    dealt = dealt.select("id", *names, *(f"has_{n}" for n in names), "way", "band", "v", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * classes.sparkSession.sparkContext.defaultParallelism)
    kind = dict(classes.dtypes)["id"]
    schema = ", ".join([f"a {kind}", f"b {kind}", *(f"d_{n} int" for n in names), *([] if links else ["hits int"])])
    met = dealt.repartition(tasks, *key).groupBy(*key).applyInPandas(_unit_pairs(rule, links), schema)
    return met.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


def perceptual_groups(hashes: DataFrame, rule: PairRule = PairRule()) -> DataFrame:
    """id, group_id (the first id of its group) and image_count of rows (id, hashes) that are near another one.

    Rows with equal hashes form one class first, so copies make no pairs.
    """
    names = [n for n, _ in rule.thresholds]
    hashes = written(hashes, "hashes")
    classes = hash_classes(hashes, rule)
    roots = components(written(near_links(classes, rule), "links"))
    named = classes.join(roots.hint("merge"), "id", "left").select(*(F.col(n).alias(f"_{n}") for n in names), F.coalesce("root", "id").alias("group_id"), "copies")
    enough = reduce(lambda a, b: a + b, (F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names)) >= rule.min_hits
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names))
    # written, so that the joins below may split a large class or group
    member = written(hashes.where(enough).join(written(named, "classes").hint("merge"), on).select("id", "group_id"), "members")
    counts = written(member.groupBy("group_id").agg(F.count("*").alias("image_count")).where("image_count > 1"), "counts")
    return member.join(counts.hint("merge"), "group_id").select("id", "group_id", "image_count")


def evidence(pairs: DataFrame, roots: DataFrame, rule: PairRule = PairRule()) -> DataFrame:
    """group_id and the sorted names of hashes by which any linked pair (or link) of the group hits."""
    hit = F.array_compact(F.array(*(F.when(F.col(f"d_{n}") <= t, F.lit(n)) for n, t in rule.thresholds)))
    of = pairs.join(roots.select(F.col("id").alias("a"), F.col("root").alias("group_id")).hint("merge"), "a")
    return of.select("group_id", F.explode(hit).alias("h")).groupBy("group_id").agg(F.sort_array(F.collect_set("h")).alias("hit_evidence"))


def stats(exact: DataFrame, perceptual: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts: groups of either type, images in groups, images checked."""
    kinds = exact.select("group_id", F.lit("exact").alias("t")).unionAll(perceptual.select("group_id", F.lit("perceptual").alias("t")))
    found = kinds.agg(
        F.count_distinct(F.when(F.col("t") == "exact", F.col("group_id"))).alias("total_exact_groups"),
        F.count_distinct(F.when(F.col("t") == "perceptual", F.col("group_id"))).alias("total_perceptual_groups"),
        F.count("*").alias("total_duplicate_images"),
    )
    return found.withColumn("total_images_checked", F.lit(files.count()).cast("long"))


def reviews(log: DataFrame) -> DataFrame:
    """group_id, action and note that a log of partial updates (group_id, action, note, seq) leaves: the last value of each that is not null."""
    return merge_fields(log, "group_id", ["action", "note"])


def with_reviews(groups: DataFrame, reviews_: DataFrame, group_type: str | None = None) -> DataFrame:
    """Groups (of one type) with the action and note of their review, null without one."""
    chosen = groups if group_type is None else groups.where(F.col("group_type") == group_type)
    return chosen.join(reviews_, "group_id", "left").select(*groups.columns, "action", "note")
