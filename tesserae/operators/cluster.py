"""Clustering of feature tables: reduction, density clusters, refinement, information.

HDBSCAN and what it needs see all rows of their table (a dataset's images, or
one cluster of them).  Up to MAX_POINTS rows that is one task; beyond, the same
values come from many tasks (``Wide``), each with a span of the rows against
those that can matter to them, and only the tree's n - 1 merges are made on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.config import Recipe
from tesserae.operators import metrics, stats
from tesserae.operators.graph import cut

MAX_POINTS = 20_000
#: Beyond MAX_POINTS: spans of rows whose pairs are a task each, and distances that a task holds at once.
SPANS, CELLS = 12, 4_000_000
#: Beyond MAX_POINTS: rows of a box of neighbours, and basins of the tree that are joined by their lightest edges.
LEAF, MOST_BASINS = 256, 2_000
#: Distances that a kernel over one task's rows holds at once, so that its memory doesn't grow with them.
BLOCK_CELLS = 1_000_000


# ---- NumPy kernels ----------------------------------------------------------------------------------------------


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    d -= 2 * x @ y.T
    np.maximum(d, 0.0, out=d)
    return np.sqrt(d, out=d)


def blocks(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows at a time, and their distances to all rows: -1 to the row itself."""
    step = max(1, min(1024, BLOCK_CELLS // max(len(x), 1)))
    for a in range(0, len(x), step):
        d = distances(x[a : a + step], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = -1.0
        yield slice(a, a + len(d)), d


def neighbors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest rows (the row itself first), in blocks."""
    k = min(k, len(x))
    ids, far = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    for rows, d in blocks(x):
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1), 1)
        ids[rows], far[rows] = near, np.maximum(np.take_along_axis(d, near, 1), 0.0)
    return ids, far


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """The distance of each row to its k-th nearest (the row itself first)."""
    core = np.empty(len(x))
    for rows, d in blocks(x):
        d.partition(k - 1, axis=1)
        core[rows] = np.maximum(d[:, k - 1], 0.0)
    return core


def pca(x: np.ndarray, k: int) -> np.ndarray:
    """Scores on the first k principal axes; each axis's largest loading is positive."""
    c = x - x.mean(axis=0)
    _, v = np.linalg.eigh(c.T @ c)
    v = v[:, ::-1][:, : min(k, x.shape[1])]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return c @ v


def umap(x: np.ndarray, k: int, n_neighbors: int = 15, min_dist: float = 0.05, epochs: int = 200, seed: int = 42, nearest: Callable = neighbors) -> np.ndarray:
    """A layout of the fuzzy neighbour graph, from principal scores, by attraction along edges and sampled repulsion."""
    n = len(x)
    if n <= k + 2:
        return np.pad(pca(x, k), ((0, 0), (0, max(0, k - x.shape[1]))))
    ids, far = nearest(x, min(n_neighbors + 1, n))
    ids, far = ids[:, 1:], far[:, 1:]
    rho = far[:, 0]
    target = np.log2(far.shape[1])
    low, high = np.full(n, 1e-6), np.full(n, max(far.max(), 1e-3) * 20)
    for _ in range(50):  # the bandwidth at which memberships add up to log2 of the neighbours
        mid = (low + high) / 2
        over = np.exp(-np.maximum(far - rho[:, None], 0) / mid[:, None]).sum(1) > target
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    member = np.exp(-np.maximum(far - rho[:, None], 0) / high[:, None])
    rows = np.repeat(np.arange(n), ids.shape[1])
    key = np.concatenate([rows * n + ids.ravel(), ids.ravel() * n + rows])
    edge, at = np.unique(key, return_inverse=True)
    total, product = np.zeros(len(edge)), np.ones(len(edge))
    weight = np.concatenate([member.ravel(), np.zeros(member.size)])
    back = np.concatenate([np.zeros(member.size), member.ravel()])
    one, two = np.zeros(len(edge)), np.zeros(len(edge))
    np.add.at(one, at, weight)
    np.add.at(two, at, back)
    total, product = one + two, one * two
    strength = total - product
    head, tail = edge // n, edge % n
    # the curve 1 / (1 + a d^2b) that is 1 up to min_dist and decays after it
    d = np.linspace(0, 3, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist)))
    grid = [(a, b) for a in np.linspace(0.5, 3, 51) for b in np.linspace(0.5, 1.5, 41)]
    a, b = min(grid, key=lambda ab: float(((1 / (1 + ab[0] * d ** (2 * ab[1])) - want) ** 2).sum()))
    rng = np.random.default_rng(seed)
    y = np.pad(pca(x, k), ((0, 0), (0, max(0, k - x.shape[1]))))
    y = 10 * y / max(np.abs(y).max(), 1e-9) + rng.normal(0, 1e-4, (n, k))
    p = strength / strength.max()
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        live = rng.random(len(p)) < p
        h, t = head[live], tail[live]
        gap = y[h] - y[t]
        d2 = (gap**2).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)[:, None] * gap
        move = np.zeros_like(y)
        np.add.at(move, h, np.clip(pull, -4, 4))
        for _ in range(3):
            other = rng.integers(0, n, len(h))
            gap = y[h] - y[other]
            d2 = (gap**2).sum(1)
            push = (2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * gap
            np.add.at(move, h, np.clip(np.where((h == other)[:, None], 0, push), -4, 4))
        degree = np.maximum(np.bincount(h, minlength=n), 1)[:, None]
        y += rate * move / np.sqrt(degree)
    return y


def _tree(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges (from, to, distance) of the minimum spanning tree by mutual reachability, shortest first."""
    n = len(x)
    core = core_distances(x, min(min_samples + 1, n))
    best, of = np.full(n, np.inf), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core), core[at])
        better = (d < best) & ~inside
        best[better], of[better] = d[better], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((of[at], at, best[at]))
    return np.array(sorted(edges, key=lambda e: e[2])).reshape(-1, 3)


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None, method: str = "eom", tree: Callable = _tree) -> np.ndarray:
    """Density clusters, -1 for noise, numbered by their first row.

    The spanning tree is merged bottom up, condensed to splits of at least
    ``min_cluster_size`` rows on both sides, and clusters are chosen by
    excess of mass (``eom``) or as leaves; the root never is one.
    """
    n = len(x)
    if n < max(2 * min_cluster_size, 3):
        return np.full(n, -1)
    edges = tree(x, min_samples or min_cluster_size)
    parent = np.arange(2 * n - 1)
    size = np.ones(2 * n - 1, np.int64)
    kids = np.full((2 * n - 1, 2), -1)
    height = np.zeros(2 * n - 1)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    new = n - 1
    for u, v, d in edges:
        a, b = root(int(u)), root(int(v))
        if a == b:  # only ``Wide`` has edges besides those of the tree
            continue
        new += 1
        parent[a] = parent[b] = new
        kids[new], size[new], height[new] = (a, b), size[a] + size[b], d
    lam = lambda d: 1.0 / max(d, 1e-12)

    def rows(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack += kids[u].tolist()
        return out

    birth, stable, below, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    stack, count = [(2 * n - 2, 0)], 1
    while stack:
        v, c = stack.pop()
        if v < n:
            continue
        now = lam(height[v])
        big = [int(u) for u in kids[v] if size[u] >= min_cluster_size]
        if len(big) == 2:
            stable[c] += size[v] * (now - birth[c])
            for u in big:
                birth[count], stable[count], below[count], members[count] = now, 0.0, [], []
                below[c].append(count)
                stack.append((u, count))
                count += 1
            continue
        for u in map(int, kids[v]):
            if big and u == big[0]:
                stack.append((u, c))
            else:
                stable[c] += size[u] * (now - birth[c])
                members[c] += rows(u)
    chosen: set[int] = set()
    value: dict[int, float] = {}
    for c in range(count - 1, -1, -1):
        inner = sum(value[k] for k in below[c])
        if not below[c] or (method == "eom" and c != 0 and stable[c] >= inner):
            value[c] = stable[c]
            if c != 0:
                drop = list(below[c])
                while drop:
                    k = drop.pop()
                    chosen.discard(k)
                    drop += below[k]
                chosen.add(c)
        else:
            value[c] = inner
    labels = np.full(n, -1)
    for c in chosen:
        stack2 = [c]
        while stack2:
            k = stack2.pop()
            labels[members[k]] = c
            stack2 += below[k]
    order: dict[int, int] = {}
    for v in labels:
        if v >= 0:
            order.setdefault(int(v), len(order))
    return np.array([order.get(int(v), -1) for v in labels])


def spread(x: np.ndarray, labels: np.ndarray) -> float:
    """The mean over clusters of two rows or more of their mean distance to the centroid."""
    each = [np.linalg.norm(x[labels == c] - x[labels == c].mean(0), axis=1).mean() for c in set(labels[labels >= 0].tolist()) if (labels == c).sum() > 1]
    return round(float(np.mean(each)), 4) if each else 0.0


def distance_totals(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row's total distance to the rows of each cluster (0, 1, ..)."""
    one = np.eye(at.max() + 1)[at]
    return np.concatenate([np.maximum(d, 0.0, out=d) @ one for _, d in blocks(x)])


def silhouette_of(x: np.ndarray, labels: np.ndarray, totals: Callable = distance_totals) -> float:
    ids, at = np.unique(labels, return_inverse=True)
    if len(ids) < 2:
        return 0.0
    n = np.bincount(at).astype(float)
    total = totals(x, at)
    own = total[np.arange(len(x)), at]
    a = own / np.maximum(n[at] - 1, 1)
    mean = total / n
    mean[np.arange(len(x)), at] = np.inf
    b = mean.min(1)
    return float(np.where(n[at] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0).mean())


def _prim(x: np.ndarray, core: np.ndarray, cut: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree by mutual reachability; with ``cut``, of the edges between rows before and from it only."""
    n, t = len(x), np.ascontiguousarray(x.T)
    best, of = np.full(n, np.inf), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    at, to, far = 0, np.zeros(n - 1, np.int64), np.zeros(n - 1)
    for k in range(n - 1):
        inside[at] = True
        part = slice(0, n) if not cut else slice(cut, n) if at < cut else slice(0, cut)
        d = np.sqrt(((t[:, part] - t[:, at, None]) ** 2).sum(0))
        np.maximum(d, core[part], out=d)
        np.maximum(d, core[at], out=d)
        better = (d < best[part]) & ~inside[part]
        best[part][better], of[part][better] = d[better], at
        at = int(np.where(inside, np.inf, best).argmin())
        to[k], far[k] = at, best[at]
    return of[to], to, far


class Boxes:
    """Points in the order of boxes of at most LEAF neighbouring ones, by halves across the widest side."""

    def __init__(self, x: np.ndarray):
        parts, stack = [], [np.arange(len(x))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                parts.append(rows)
                continue
            side = x[rows, int(np.ptp(x[rows], axis=0).argmax())]
            halves = np.argpartition(side, len(rows) // 2)
            stack += [rows[halves[len(rows) // 2 :]], rows[halves[: len(rows) // 2]]]
        self.order = np.concatenate(parts)
        self.points = x[self.order]
        self.norms = (self.points**2).sum(1)
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in parts])])
        self.low = np.minimum.reduceat(self.points, self.starts[:-1])
        self.high = np.maximum.reduceat(self.points, self.starts[:-1])

    def __len__(self) -> int:
        return len(self.low)

    def rows(self, box: int) -> np.ndarray:
        return np.arange(self.starts[box], self.starts[box + 1])

    def columns(self, boxes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rows(b) for b in boxes]) if len(boxes) else np.zeros(0, np.int64)

    def gaps(self, box: int) -> np.ndarray:
        """What each box's points are away from those of ``box`` at least, a rounding error less."""
        gap = np.sqrt((np.maximum(np.maximum(self.low - self.high[box], self.low[box] - self.high), 0.0) ** 2).sum(1))
        return gap * (1 - 1e-9) - 1e-6 * (1 + np.sqrt(self.norms.max())) * (gap > 0)

    def distances(self, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of the rows at a time, and their distances to the columns."""
        to, norms = self.points[columns].T, self.norms[columns]
        step = max(1, BLOCK_CELLS // max(len(columns), 1))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            d = (-2 * self.points[some]) @ to
            d += norms
            d += self.norms[some, None]
            np.maximum(d, 0.0, out=d)
            yield some, np.sqrt(d, out=d)


def _cores(boxes: Boxes, box: int, k: int) -> np.ndarray:
    """The distance to the k-th nearest point (itself first) of a box's points: a bound from the nearest boxes, then what lies within."""
    rows, gap = boxes.rows(box), boxes.gaps(box)
    near = np.argsort(gap, kind="stable")
    some = near[: 1 + np.searchsorted(np.cumsum(np.diff(boxes.starts)[near]), min(4 * k, len(boxes.points)))]
    bound = np.concatenate([np.partition(d, k - 1, axis=1)[:, k - 1] for _, d in boxes.distances(rows, boxes.columns(some))])
    within = np.flatnonzero(gap <= bound.max())
    rest = within[~np.isin(within, some)]
    if not len(rest):
        return bound
    limit, out = bound * (1 + 1e-9) + 1e-9, []
    for part, d in boxes.distances(rows, boxes.columns(np.concatenate([some, rest]))):
        for at, far in zip(part - rows[0], d, strict=True):
            out.append(np.partition(far[far <= limit[at]], k - 1)[k - 1])
    return np.array(out)


def _lower(boxes: Boxes, box: int, core: np.ndarray, rank: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For a box's points one of lower rank within their core distance: in the box, else the lowest of all; or the point itself."""
    rows, gap = boxes.rows(box), boxes.gaps(box)
    out = rows.copy()

    def look(of: np.ndarray, columns: np.ndarray) -> None:
        for part, d in boxes.distances(of, columns):
            best = np.where(d <= core[part, None], rank[columns], len(rank)).argmin(axis=1)
            found = (d[np.arange(len(part)), best] <= core[part]) & (rank[columns[best]] < rank[part])
            out[part[found] - rows[0]] = columns[best[found]]

    look(rows, rows)
    for row in rows[out == rows]:
        there = np.flatnonzero((gap <= core[row]) & (least < rank[row]))
        if len(there):
            look(np.array([row]), boxes.columns(there))
    return out


def _lightest(boxes: Boxes, rows: np.ndarray, columns: np.ndarray, core: np.ndarray, basin: np.ndarray) -> dict[str, np.ndarray]:
    """The smallest mutual reachability w between rows and columns of two basins a < b."""
    columns, rows = (v[np.argsort(basin[v], kind="stable")] for v in (columns, rows))
    of, first = np.unique(basin[columns], return_index=True)
    mine = np.unique(basin[rows])
    best = np.full((len(mine), len(of)), np.inf)
    for part, d in boxes.distances(rows, columns):
        np.maximum(d, core[columns], out=d)
        each = np.maximum(np.minimum.reduceat(d, first, axis=1), core[part, None])
        some, start = np.unique(basin[part], return_index=True)
        at = np.searchsorted(mine, some)
        best[at] = np.minimum(best[at], np.minimum.reduceat(each, start, axis=0))
    i, j = np.nonzero(mine[:, None] != of)
    return {"a": np.minimum(mine[i], of[j]), "b": np.maximum(mine[i], of[j]), "w": best[i, j]}


def _joined(pairs: pd.DataFrame, n: int) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """A minimum spanning forest of the pairs (a, b, w) of n basins, and the height at which it joins each two of them."""
    edges, height = [], np.full((n, n), np.inf)
    np.fill_diagonal(height, 0.0)
    group, members = np.arange(n), {i: np.array([i]) for i in range(n)}
    for a, b, w in pairs.sort_values(["w", "a", "b"])[["a", "b", "w"]].itertuples(index=False):
        i, j = group[a], group[b]
        if i != j:
            edges.append((int(a), int(b), float(w)))
            height[np.ix_(members[i], members[j])] = w
            height[np.ix_(members[j], members[i])] = w
            members[i] = np.concatenate([members[i], members.pop(j)])
            group[members[i]] = i
    return edges, height


class Wide:
    """The quadratic kernels for more than MAX_POINTS rows: all points are broadcast, spans of rows are dealt over tasks.

    Work grows with the square of the rows at most; a task holds the points and
    CELLS distances, the driver the points and a tree's edges.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.trees: dict[int, np.ndarray] = {}

    def over(self, tasks: int, each: Callable[[int], pd.DataFrame], schema: str) -> pd.DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k in b["id"].tolist():
                    yield each(k)

        return self.spark.range(0, tasks, 1, tasks).mapInPandas(run, schema).toArrow().to_pandas()

    def over_rows(self, x: np.ndarray, each: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> pd.DataFrame:
        """What ``each`` makes of some rows' distances (-1 to the row itself) and the rows' numbers, in row order."""
        n, tasks = len(x), 8 * SPANS
        shared, cells = self.spark.sparkContext.broadcast(x), CELLS

        def span(k: int) -> pd.DataFrame:
            points, parts, step = shared.value, [], max(1, cells // n)
            for a in range(k * n // tasks, (k + 1) * n // tasks, step):
                rows = np.arange(a, min(a + step, (k + 1) * n // tasks))
                d = distances(points[rows], points)
                d[np.arange(len(rows)), rows] = -1.0
                parts.append(pd.DataFrame(each(d, rows)))
            return pd.concat(parts)

        out = self.over(tasks, span, schema).sort_values("row", kind="stable")
        shared.unpersist()
        return out

    def neighbors(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As the function of this name."""

        def each(d: np.ndarray, rows: np.ndarray) -> dict:
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1), 1)
            return {"row": np.repeat(rows, k), "id": near.ravel(), "far": np.maximum(np.take_along_axis(d, near, 1), 0.0).ravel()}

        out = self.over_rows(x, each, "row long, id long, far double")
        return out["id"].to_numpy().reshape(-1, k), out["far"].to_numpy().reshape(-1, k)

    def totals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As ``distance_totals``."""
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(at.max() + 1))

        def each(d: np.ndarray, rows: np.ndarray) -> dict:
            d = np.maximum(d, 0.0)
            return {"row": rows, "total": list(np.add.reduceat(d, starts, axis=1))}

        out = np.empty((len(x), len(starts)))
        out[order] = np.stack(self.over_rows(x[order], each, "row long, total array<double>")["total"])
        return out

    def tree(self, x: np.ndarray, min_samples: int) -> np.ndarray:
        """Edges, shortest first, of a minimum spanning tree by mutual reachability of the one ``x`` of this object.

        No edge of a row is lighter than its core distance, so an edge to a row
        of lower core distance within it is in some smallest tree.  These edges
        make basins around the rows without one, few as a core distance reaches
        many rows; the rest of the tree are lightest edges between basins.
        """
        if min_samples in self.trees:
            return self.trees[min_samples]
        n, k = len(x), min(min_samples + 1, len(x))
        boxes = Boxes(x)
        shared = self.spark.sparkContext.broadcast(boxes)

        def each_box(of: Callable[[Boxes, int], object], schema: str) -> pd.DataFrame:
            tasks, m = min(8 * SPANS, len(boxes)), len(boxes)
            return self.over(tasks, lambda t: pd.concat([pd.DataFrame(of(shared.value, q)) for q in range(t, m, tasks)]), schema)

        core = each_box(lambda at, q: {"row": at.rows(q), "core": _cores(at, q, k)}, "row long, core double").sort_values("row")["core"].to_numpy()
        rank = np.empty(n, np.int64)
        rank[np.lexsort((boxes.order, core))] = np.arange(n)
        known = self.spark.sparkContext.broadcast((core, rank, np.minimum.reduceat(rank, boxes.starts[:-1])))
        to = each_box(lambda at, q: {"row": at.rows(q), "to": _lower(at, q, *known.value)}, "row long, to long").sort_values("row")["to"].to_numpy()
        known.unpersist()
        root = to
        while (root[root] != root).any():
            root = root[root]
        roots, basin = np.unique(root, return_inverse=True)
        if len(roots) > MOST_BASINS:
            shared.unpersist()
            out = np.empty(n)
            out[boxes.order] = core
            return self._tree_by_spans(x, out, min_samples)
        found = self._between(boxes, each_box, core, basin, len(roots)) if len(roots) > 1 else []
        shared.unpersist()
        low = np.flatnonzero(to != np.arange(n))
        edges = np.concatenate([np.stack([boxes.order[low], boxes.order[to[low]], core[low]], 1), np.array([(boxes.order[roots[a]], boxes.order[roots[b]], w) for a, b, w in found]).reshape(-1, 3)])
        # edges within a basin first, so that no row is left out where two basins join at its height
        late = np.arange(n - 1) >= len(low)
        self.trees[min_samples] = edges[np.lexsort((edges[:, 0], late, edges[:, 2]))]
        return self.trees[min_samples]

    def _between(self, boxes: Boxes, each_box: Callable, core: np.ndarray, basin: np.ndarray, n: int) -> list[tuple[int, int, float]]:
        """The lightest edges that join basins: of near boxes first, whose heights then bound which boxes and rows can be nearer."""
        box_of = np.repeat(np.arange(len(boxes)), np.diff(boxes.starts))
        entry = pd.DataFrame({"box": box_of, "basin": basin, "core": core}).groupby(["box", "basin"], as_index=False)["core"].min()
        at_box, at_basin, least = (entry[c].to_numpy() for c in ("box", "basin", "core"))
        known = self.spark.sparkContext.broadcast((core, basin, at_box, at_basin, least))

        none = {"a": np.zeros(0, int), "b": np.zeros(0, int), "w": np.zeros(0)}

        def near(at: Boxes, q: int) -> dict:
            core, basin, *_ = known.value
            rows, columns = at.rows(q), at.columns(np.argsort(at.gaps(q), kind="stable")[:12])
            return _lightest(at, rows, columns, core, basin) if (basin[columns] != basin[rows[0]]).any() else none

        some = each_box(near, "a int, b int, w double").groupby(["a", "b"], as_index=False)["w"].min()
        bounds = self.spark.sparkContext.broadcast(_joined(some, n)[1])

        def far(at: Boxes, q: int) -> dict:
            (core, basin, at_box, at_basin, least), height = known.value, bounds.value
            rows, gap = at.rows(q), at.gaps(q)
            rows = rows[core[rows] < height[basin[rows]].max(axis=1)]
            if not len(rows):
                return none
            reach, floor = height[np.unique(basin[rows])].max(axis=0), core[rows].min()
            open_ = np.maximum(np.maximum(gap[at_box], floor), least) < reach[at_basin]
            columns = at.columns(np.unique(at_box[open_ & (at_box >= q)]))
            columns = columns[np.maximum(core[columns], floor) < reach[basin[columns]]]
            found = _lightest(at, rows, columns, core, basin) if len(columns) else none
            less = found["w"] < height[found["a"], found["b"]]
            return {c: v[less] for c, v in found.items()}

        rest = each_box(far, "a int, b int, w double").groupby(["a", "b"], as_index=False)["w"].min()
        for b in (known, bounds):
            b.unpersist()
        return _joined(pd.concat([some, rest]), n)[0]

    def _tree_by_spans(self, x: np.ndarray, core: np.ndarray, min_samples: int) -> np.ndarray:
        """Edges, shortest first, that hold the tree: for core distances that reach few rows, so that there are many basins.

        An edge of the tree is the lightest across some cut, so it is in the
        tree of any part of the graph that has it: the trees within each span
        and between each two of them hold all edges of the whole tree.
        """
        n = len(x)
        pairs = [(i, j) for i in range(SPANS) for j in range(i, SPANS)]
        cuts = [i * n // SPANS for i in range(SPANS + 1)]
        shared = self.spark.sparkContext.broadcast((x, core))

        def between(p: int) -> pd.DataFrame:
            (i, j), (points, reach) = pairs[p], shared.value
            first, second = np.arange(cuts[i], cuts[i + 1]), np.arange(cuts[j], cuts[j + 1])
            rows = first if i == j else np.concatenate([first, second])
            u, v, d = _prim(points[rows], reach[rows], 0 if i == j else len(first))
            return pd.DataFrame({"u": rows[u], "v": rows[v], "d": d})

        edges = self.over(len(pairs), between, "u int, v int, d double")
        shared.unpersist()
        self.trees[min_samples] = edges.sort_values(["d", "u", "v"]).to_numpy(float)
        return self.trees[min_samples]


def mutual_information(values: np.ndarray, labels: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Mutual information (nats) of a continuous value and a class, by nearest neighbours within the class."""
    rng = np.random.default_rng(seed)
    x = values.astype(float)
    x = x + 1e-10 * max(1.0, np.abs(x).mean()) * rng.standard_normal(len(x))
    size = pd.Series(labels).map(pd.Series(labels).value_counts()).to_numpy()
    keep = size > 1
    x, y, size = x[keep], np.asarray(labels)[keep], size[keep]
    n = len(x)
    if n == 0:
        return 0.0
    ks, radius = np.minimum(k, size - 1), np.empty(n)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        order = at[np.argsort(x[at])]
        s, kk = x[order], min(k, len(at) - 1)
        pads = np.concatenate([np.full(kk, -np.inf), s, np.full(kk, np.inf)])
        around = np.stack([np.abs(pads[j : j + len(s)] - s) for j in range(2 * kk + 1) if j != kk])
        radius[order] = np.partition(around, kk - 1, axis=0)[kk - 1]
    # strictly nearer than the k-th neighbour, whatever way sums are rounded
    radius = np.maximum(radius - np.maximum(radius * 1e-9, 4 * np.finfo(float).eps * np.abs(x)), 0.0)
    s = np.sort(x)
    m = np.searchsorted(s, x + radius, "right") - np.searchsorted(s, x - radius, "left")
    psi = np.concatenate([[np.nan], -0.5772156649015329 + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])])
    return max(0.0, float(psi[n] + psi[ks].mean() - psi[size].mean() - psi[m].mean()))


# ---- operators --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sizes:
    """Parameters of a density clustering that follow from the number of rows."""

    min_cluster_size: int
    min_samples: int

    @classmethod
    def of(cls, n: int, ratio: float, samples_ratio: float, granularity: float = 1.0) -> Sizes:
        size = max(min(50, int(n * 0.05)), max(3, int(n * ratio * granularity)), 5)
        return cls(size, max(3, int(size * samples_ratio)))


def neighbor_count(n: int, wanted: int) -> int:
    return max(2, min(wanted, max(15, int(n**0.5)), 100, n - 1))


def on_points(df: DataFrame, names: Sequence[str], key: str, compute: Callable[[np.ndarray], np.ndarray], label: str = "cluster_id") -> DataFrame:
    """``df`` with the labels that ``compute`` gives its points, in key order."""
    points = df.select(key, *names).orderBy(key).toArrow().to_pandas()
    labels = compute(points[list(names)].to_numpy(float)) if len(points) else np.zeros(0, int)
    kind = dict(df.dtypes)[key]
    table = pa.Table.from_pandas(pd.DataFrame({key: points[key], label: labels.astype(np.int32)}), preserve_index=False)
    return df.drop(label).join(df.sparkSession.createDataFrame(table).select(F.col(key).cast(kind), label), key)


def density_clusters(df: DataFrame, names: Sequence[str], key: str, recipe: Recipe = Recipe("default"), embed: str = "pca", method: str = "eom") -> DataFrame:
    """``df`` (scaled features) with cluster_id: a reduction (``pca``, ``umap`` or ``raw``), then HDBSCAN.

    Up to three rounds: a dominant cluster (over half) makes the granularity
    1.3 times coarser, weak or smoothed ones lower the smallest size by 3;
    the round with the best silhouette counts.
    """

    def compute(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < 10:
            return np.full(n, -1)
        wide = Wide(df.sparkSession) if n > MAX_POINTS else None
        tree, totals, nearest = (wide.tree, wide.totals, wide.neighbors) if wide else (_tree, distance_totals, neighbors)
        y = x if embed == "raw" else pca(x, recipe.components) if embed == "pca" else umap(x, recipe.components, neighbor_count(n, recipe.neighbors), recipe.min_dist, seed=recipe.seed, nearest=nearest)
        granularity, smaller = 1.0, 0
        best, best_score = np.full(n, -1), -2.0
        for _ in range(3):
            s = Sizes.of(n, recipe.cluster_size_ratio, recipe.min_samples_ratio, granularity)
            labels = hdbscan(y, max(s.min_cluster_size - smaller, 5), s.min_samples, method, tree)
            real = labels >= 0
            score = silhouette_of(y[real], labels[real], totals) if real.sum() > 1 else 0.0
            if score > best_score:
                best, best_score = labels, score
            sizes = np.bincount(labels[real]) if real.any() else np.zeros(0)
            dominant = sizes.size > 0 and sizes.max() > 0.5 * n
            smooth = len(sizes) <= 2 and score < 0.3
            weak = len(sizes) > 2 and (sizes < 0.02 * n).mean() > 0.3
            if not (dominant or smooth or weak):
                break
            granularity = min(granularity * 1.3, 2.0) if dominant else granularity
            smaller += 3 if weak or smooth else 0
        return best

    return on_points(df, names, key, compute)


def embedding(df: DataFrame, names: Sequence[str], key: str, k: int = 3, method: str = "pca", recipe: Recipe = Recipe("default")) -> DataFrame:
    """key and coordinates x1..xk; one task, MAX_POINTS rows at most."""
    n = df.count()
    if n > MAX_POINTS and method == "umap":
        raise ValueError(f"{n} rows; a layout takes {MAX_POINTS} at most")
    points = df.select(key, *names).orderBy(key).toPandas() if n <= MAX_POINTS else None
    if points is None:
        return _pca_wide(df, names, key, k)
    x = points[list(names)].to_numpy(float)
    y = pca(x, k) if method == "pca" else umap(x, k, neighbor_count(n, recipe.neighbors), recipe.min_dist, seed=recipe.seed)
    return df.sparkSession.createDataFrame(pd.concat([points[[key]], pd.DataFrame(y, columns=[f"x{i + 1}" for i in range(y.shape[1])])], axis=1))


def _pca_wide(df: DataFrame, names: Sequence[str], key: str, k: int) -> DataFrame:
    """Principal scores of any number of rows: covariances are one aggregate row, scores plain columns."""
    row = df.agg(*(F.avg(a).alias(f"m{i}") for i, a in enumerate(names)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    v = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return df.select(key, *(sum(((F.col(a) - row[f"m{i}"]) * float(v[i, c]) for i, a in enumerate(names)), F.lit(0.0)).alias(f"x{c + 1}") for c in range(v.shape[1])))


def information(df: DataFrame, names: Sequence[str], cluster: str = "cluster_id", seed: int = 42, most: int = MAX_POINTS) -> DataFrame:
    """feature and mi with the cluster, noise left out; up to ``most`` rows a task for each feature, beyond it by sorts."""
    rows = df.where(F.col(cluster) >= 0)
    if rows.count() > most:
        return _information_wide(rows, names, cluster, seed)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["value", "c"])
        return pd.DataFrame({"feature": part["feature"].iloc[:1], "mi": [mutual_information(part["value"].to_numpy(), part["c"].to_numpy(), seed=seed)]})

    return stats.melt(rows, names, [cluster]).withColumnRenamed(cluster, "c").groupBy("feature").applyInPandas(each, "feature string, mi double")


def _digamma(m: Column) -> Column:
    """psi of whole numbers from 1."""
    x = m + 8.0
    tail = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return tail - sum((1 / (m + float(i)) for i in range(1, 8)), 1 / m.cast("double"))


def _information_wide(rows: DataFrame, names: Sequence[str], cluster: str, seed: int, k: int = 3) -> DataFrame:
    """``mutual_information`` of any number of rows, all of them counted.

    The neighbours within a class are lags of its sorted values.  The ends of
    each row's radius are sorted among all values by range, and running counts
    of values (each part's own, and its offset) say how many lie between.
    """
    size = {r[0]: r[1] for r in rows.groupBy(cluster).count().collect() if r[1] > 1}
    n = sum(size.values())
    if n == 0:
        return rows.sparkSession.createDataFrame([(f, 0.0) for f in names], "feature string, mi double")
    scale = rows.agg(*(F.avg(F.abs(f)).alias(f) for f in names)).first()
    pick = lambda table, of: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[of]
    # equal values are told apart by noise, as those of mutual_information are
    same = stats.melt(rows.where(F.col(cluster).isin(list(size))), names, [cluster]).withColumnRenamed(cluster, "c").groupBy("feature", "c", "value").count()
    each = same.select("feature", "c", "value", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))
    even = lambda i: (F.shiftrightunsigned(F.xxhash64("feature", "c", "value", "nth", F.lit(seed), F.lit(i)), 11) + 0.5) / float(2**53)
    normal = F.sqrt(-2 * F.log(even(0))) * F.cos(2 * np.pi * even(1))
    width = pick({f: 1e-10 * max(1.0, scale[f] or 0.0) for f in names}, F.col("feature"))
    values = each.select("feature", "c", (F.col("value") + width * normal).alias("x"))
    own = Window.partitionBy("feature", "c").orderBy("x")
    gaps = F.sort_array(F.filter(F.array(*(F.abs(f("x", j).over(own) - F.col("x")) for f in (F.lag, F.lead) for j in range(1, k + 1))), lambda v: v.isNotNull()))
    near = values.select("feature", "c", "x", F.row_number().over(own).alias("place"), gaps.alias("gaps"))
    near = near.withColumn("r", F.element_at("gaps", pick({c: min(k, m - 1) for c, m in size.items()}, F.col("c"))))
    r = F.greatest(F.col("r") - F.greatest(F.col("r") * 1e-9, 4 * np.finfo(float).eps * F.abs("x")), F.lit(0.0))
    ends = F.array(*(F.struct(at.alias("at"), F.lit(kind).alias("kind")) for at, kind in ((F.col("x") - r, 0), (F.col("x"), 1), (F.col("x") + r, 2))))
    events = near.select("feature", "c", "place", F.explode(ends).alias("e")).select("feature", "c", "place", "e.at", "e.kind")

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            count = seen + np.cumsum(b["kind"].to_numpy() == 1)
            seen = int(count[-1]) if len(count) else seen
            yield b[["feature", "c", "place", "kind"]].assign(part=np.int32(part), seen=count)

    counted = cut(events.orderBy("feature", "at", "kind").mapInPandas(running, f"feature string, c {dict(events.dtypes)['c']}, place int, kind int, part int, seen long"))
    start, before = 0, {}
    for p in counted.groupBy("part").agg(F.max("seen").alias("n")).orderBy("part").collect():
        before[p["part"]], start = start, start + p["n"]
    upto = F.col("seen") + pick(before, F.col("part"))
    within = counted.where("kind != 1").groupBy("feature", "c", "place").agg(F.sum(F.when(F.col("kind") == 2, upto).otherwise(-upto)).alias("m"))
    psi = lambda v: float(-0.5772156649015329 + (1 / np.arange(1, v)).sum())
    fixed = psi(n) + sum(m * (psi(min(k, m - 1)) - psi(m)) for m in size.values()) / n
    return within.groupBy("feature").agg(F.greatest(F.lit(0.0), F.lit(fixed) - F.avg(_digamma(F.col("m")))).alias("mi"))


def compare_pipelines(df: DataFrame, names: Sequence[str], key: str, recipe: Recipe = Recipe("default")) -> dict:
    """Clusters of the scaled features themselves (a) and of their reduction (b), their scores, and the better; a on ties."""
    out = {}
    for name, embed in (("a", "raw"), ("b", "pca")):
        labelled = density_clusters(df, names, key, recipe, embed).cache()
        size = metrics.sizes(labelled).first()
        two = size["clusters"] >= 2
        sil = metrics.silhouette(labelled, names, key, noise=True).first()[0] if two else 0.0
        db = metrics.davies_bouldin(labelled, names).first()[0] if two else 0.0
        out[name] = {"labels": labelled, "score": metrics.pipeline_score(sil, size["noise_rate"], size["clusters"], db), "silhouette": sil, "davies_bouldin": db, "clusters": size["clusters"], "noise_rate": size["noise_rate"]}
    out["selected"] = "a" if out["a"]["score"] >= out["b"]["score"] else "b"
    return out


@dataclass(frozen=True)
class Gates:
    """What a split of a cluster must meet to be accepted."""

    min_size: int
    ratio: float
    smallest: int
    samples_ratio: float
    fewest_samples: int
    most_noise: float
    most_largest: float
    gain: float


def gates(size: int, adaptive: bool = True, min_size: int = 30) -> Gates | None:
    """Fixed values by size; None where a cluster is too small to refine."""
    if not adaptive:
        return None if size < min_size else Gates(min_size, 0.15, 3, 0.3, 2, 0.30, 0.90, 0.0)
    if size < 20:
        return None
    if size < 40:
        return Gates(20, 0.30, 5, 0.4, 2, 0.20, 0.85, 0.08)
    if size < 100:
        return Gates(40, 0.20, 8, 0.3, 3, 0.30, 0.90, 0.05)
    return Gates(100, 0.12, 10, 0.3, 3, 0.30, 0.90, 0.05)


def refine(df: DataFrame, names: Sequence[str], key: str, cluster: str = "cluster_id", adaptive: bool = True, min_size: int = 30) -> DataFrame:
    """key, cluster, sub (the part of an accepted split, else -1), accepted, and the reason.

    Clusters refine in parallel, a task each; those over MAX_POINTS one after
    another, each dealt over many tasks, by the same rules over all rows.
    """
    kinds = dict(df.dtypes)

    def split(part: pd.DataFrame, tree: Callable = _tree) -> pd.DataFrame:
        part = part.sort_values(key)
        n = len(part)
        out = pd.DataFrame({key: part[key], cluster: part[cluster], "sub": np.full(n, -1, np.int32), "accepted": False, "reason": ""})
        g = gates(n, adaptive, min_size)
        if g is None:
            out["reason"] = f"size {n} is too small"
            return out
        x = part[list(names)].to_numpy(float)
        smallest = max(g.smallest, int(n * g.ratio))
        labels = hdbscan(pca(x, min(5, n - 1)), smallest, max(g.fewest_samples, int(smallest * g.samples_ratio)), tree=tree)
        sizes = np.bincount(labels[labels >= 0]) if (labels >= 0).any() else np.zeros(0)
        before, after = spread(x, np.zeros(n, int)), spread(x, labels)
        bad = []
        if len(sizes) < 2:
            bad.append("fewer than 2 parts")
        if (labels < 0).mean() > g.most_noise:
            bad.append("too much noise")
        if sizes.size and sizes.max() / n > g.most_largest:
            bad.append("one part is too large")
        if g.gain and after >= before * (1 - g.gain):
            bad.append("cohesion gains too little")
        out["accepted"], out["reason"] = not bad, ";".join(bad) or "ok"
        out["sub"] = labels.astype(np.int32) if not bad else np.int32(-1)
        return out

    rows = df.where(F.col(cluster) >= 0).select(key, cluster, *names)
    big = [r[0] for r in rows.groupBy(cluster).count().where(F.col("count") > MAX_POINTS).orderBy(cluster).collect()]
    schema = f"{key} {kinds[key]}, {cluster} {kinds[cluster]}, sub int, accepted boolean, reason string"
    out = rows.where(~F.col(cluster).isin(big)).groupBy(cluster).applyInPandas(lambda part: split(part), schema)
    for c in big:
        done = split(rows.where(F.col(cluster) == c).toArrow().to_pandas(), Wide(df.sparkSession).tree)
        out = out.unionAll(df.sparkSession.createDataFrame(pa.Table.from_pandas(done, preserve_index=False)).select(F.col(key).cast(kinds[key]), F.col(cluster).cast(kinds[cluster]), "sub", "accepted", "reason"))
    return out


def relabel(refined: DataFrame, df: DataFrame, key: str, cluster: str = "cluster_id") -> DataFrame:
    """``df`` with new_cluster_id: parts of accepted splits get numbers after the largest old one, by cluster and part."""
    parts = refined.where("accepted AND sub >= 0").select(cluster, "sub").distinct().orderBy(cluster, "sub").collect()
    start = 1 + (df.agg(F.max(cluster)).first()[0] or 0)
    table = df.sparkSession.createDataFrame([(r[0], r[1], start + i) for i, r in enumerate(parts)], f"{cluster} int, sub int, _new int")
    new = refined.where("sub >= 0").join(F.broadcast(table), [cluster, "sub"]).select(key, "_new")
    return df.join(new, key, "left").withColumn("new_cluster_id", F.coalesce("_new", cluster)).drop("_new")


def stability(df: DataFrame, names: Sequence[str], key: str, runs: int = 5, share: float = 0.8, recipe: Recipe = Recipe("default")) -> float:
    """Mean adjusted Rand index between clusterings of seeded subsamples, on the rows that two of them share."""
    labelled = []
    for seed in range(runs):
        part = df.where(F.xxhash64(key, F.lit(seed)) < F.lit(int(-(2**63) + 2**64 * share)))
        labelled.append(density_clusters(part, names, key, recipe).select(key, F.col("cluster_id").alias(f"l{seed}")).cache())
    scores = [metrics.rand_index(labelled[i].join(labelled[j], key), f"l{i}", f"l{j}").first()[0] for i in range(runs) for j in range(i + 1, runs)]
    return round(float(np.mean(scores)), 4)


def residual_matrix(bank: DataFrame, histogram: DataFrame, quality: DataFrame, scalars: dict[str, Sequence[str]], key: str = "image_path") -> DataFrame:
    """key and the columns r0.. of clipped z-arrays (within 5) and the scalars of two channels; 0 where a row is missing."""
    first = lambda d, cols: d.select(key, *(F.col(c).cast("double") for c in cols)).dropDuplicates([key])
    joined = bank.join(first(histogram, scalars["histogram"]), key, "left").join(first(quality, scalars["quality"]), key, "left")
    z = lambda c, n: [F.coalesce(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.get(c, F.lit(i)).cast("double"))), F.lit(0.0)) for i in range(n)]
    cols = [*z("brightness_z", 16), *z("saturation_z", 16), *z("hue_z", 24), *(F.coalesce(c, F.lit(0.0)) for c in (*scalars["histogram"], *scalars["quality"]))]
    return joined.select(key, *(c.cast("float").alias(f"r{i}") for i, c in enumerate(cols)))
