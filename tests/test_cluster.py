"""Reductions, density clusters, refinement, information, and what they are measured by."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tesserae.functions.config import PRESETS, RECIPES, Recipe, preset
from tesserae.operators import cluster, metrics, stats

NAMES = ["a", "b", "c"]


def blobs(n=60, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0]])
    return np.concatenate([c + rng.normal(0, 0.5, (n, 3)) for c in centers]), np.repeat(range(3), n)


@pytest.fixture(scope="module")
def table(spark):
    x, y = blobs()
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(id=range(len(x)), truth=y))


def test_hdbscan_finds_blobs_and_noise():
    x, y = blobs()
    x = np.concatenate([x, [[40, 40, 40], [-30, 20, 5]]])
    labels = cluster.hdbscan(x, 10, 5)
    assert set(labels[:-2]) - {-1} == {0, 1, 2} and (labels[-2:] == -1).all()
    for c in range(3):
        assert np.mean(labels[:-2][y == c] == np.bincount(labels[:-2][y == c][labels[:-2][y == c] >= 0]).argmax()) > 0.9


def test_leaf_method_and_small_inputs():
    x, _ = blobs(20)
    assert len(set(cluster.hdbscan(x, 5, 3, "leaf")) - {-1}) >= 3
    assert (cluster.hdbscan(x[:4], 5) == -1).all()


def test_umap_keeps_blobs_apart():
    x, y = blobs(40)
    z = cluster.umap(x, 2, 10, seed=1)
    assert cluster.silhouette_of(z, y) > 0.5
    assert np.allclose(z, cluster.umap(x, 2, 10, seed=1))


def test_pca_wide_equals_pca(table, spark):
    wide = cluster._pca_wide(table, NAMES, "id", 2).orderBy("id").toPandas()[["x1", "x2"]].to_numpy()
    assert np.allclose(wide, cluster.pca(blobs()[0], 2), atol=1e-8)


def test_density_clusters_and_measures(table):
    out = cluster.density_clusters(stats.robust_scale(table, NAMES), NAMES, "id", Recipe("t", components=3, cluster_size_ratio=0.1))
    assert metrics.rand_index(out, "truth", "cluster_id").first()[0] > 0.8
    assert metrics.silhouette(out, NAMES, "id").first()[0] > 0.3


def test_pipelines_and_stability(table):
    both = cluster.compare_pipelines(table, NAMES, "id", Recipe("t", components=3, cluster_size_ratio=0.1))
    assert both["selected"] in "ab" and both["a"]["clusters"] >= 2
    assert cluster.stability(table, NAMES, "id", runs=3, recipe=Recipe("t", components=3, cluster_size_ratio=0.1)) > 0.8


def test_refine(spark):
    x, y = blobs(60)
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(id=range(len(x)), cluster_id=np.where(y == 2, 1, 0)))
    done = cluster.refine(df, NAMES, "id")
    assert {r[0] for r in done.where("accepted").select("cluster_id").distinct().collect()} == {0}
    new = cluster.relabel(done, df, "id").select("new_cluster_id").distinct().collect()
    assert len(new) >= 3


def test_information(table):
    df = table.withColumnRenamed("truth", "cluster_id").selectExpr("*", "pmod(id * 7919, 101) / 101.0 AS d")
    mi = {r["feature"]: r["mi"] for r in cluster.information(df, ["a", "d"]).collect()}
    assert abs(mi["a"] - 0.63) < 0.05 and mi["d"] < 0.2
    per, by = stats.reliability(df, ["a", "d"], cluster.information(df, ["a", "d"]), {"g": ["a"], "h": ["d"]})
    assert per.count() == 2 and {r["weight"] for r in by.collect()} <= {0.5, 1.0, 1.5}
    assert stats.contribution(df, ["a", "d"], cluster.information(df, ["a", "d"])).count() == 2


def test_parameters():
    assert cluster.Sizes.of(1000, 0.015, 0.3) == cluster.Sizes(50, 15)
    assert cluster.gates(10) is None and cluster.gates(30).gain == 0.08 and cluster.gates(25, adaptive=False) is None
    assert not any(r.problems() for r in RECIPES.values())
    assert Recipe("x", features=("dominant_hue_strength", "nonsense")).problems()
    assert preset("custom", {"color": 2.0}) == {"color": 2.0} and set(PRESETS) == {"lighting", "color", "geometry", "full"}
    with pytest.raises(ValueError):
        preset("none")
    assert metrics.advice("moderate", 1, 2, 2, 0.3, 5, 10)[0][0] == "dominant_cluster" and metrics.advice("healthy", 0, 5, 0, 0.0, 0, 10) == [("none", "none")]


def test_residual_matrix(spark):
    bank = spark.createDataFrame([("a", [9.0] * 16, [0.0] * 16, [-9.0] * 24), ("b", [1.0] * 16, [0.0] * 16, [0.0] * 24)], "image_path string, brightness_z array<double>, saturation_z array<double>, hue_z array<double>")
    h = spark.createDataFrame([("a", 0.5)], "image_path string, h1 double")
    q = spark.createDataFrame([("a", 0.25), ("a", 0.25)], "image_path string, q1 double")
    rows = {r[0]: r[1:] for r in cluster.residual_matrix(bank, h, q, {"histogram": ["h1"], "quality": ["q1"]}).collect()}
    assert len(rows["a"]) == 58 and max(rows["a"]) == 5 and min(rows["a"]) == -5 and rows["a"][-2:] == (0.5, 0.25) and rows["b"][-2:] == (0, 0)


def test_large_clusters_are_refined_by_all_rows(spark, monkeypatch):
    x, y = blobs(120, 3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(id=range(len(x)), cluster_id=np.where(y == 2, 1, 0)))
    whole = sorted(cluster.refine(df, NAMES, "id").collect())
    monkeypatch.setattr(cluster, "MAX_POINTS", 200)
    done = cluster.refine(df, NAMES, "id")
    assert sorted(done.collect()) == whole
    assert {r[0] for r in done.where("accepted").select("cluster_id").distinct().collect()} == {0}


@pytest.mark.parametrize("embed", ["pca", "raw", "umap"])
def test_density_clusters_see_all_rows(spark, monkeypatch, embed):
    x, _ = blobs(120, 4)
    x = np.concatenate([x, [[60, 60, 60], [-50, 10, 0], [0, -70, 20]]])  # nearest to a cluster, but in none
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(id=range(len(x))))
    recipe = Recipe("t", components=3, cluster_size_ratio=0.1)
    whole = sorted(cluster.density_clusters(df, NAMES, "id", recipe, embed).select("id", "cluster_id").collect())
    monkeypatch.setattr(cluster, "MAX_POINTS", 200)
    done = sorted(cluster.density_clusters(df, NAMES, "id", recipe, embed).select("id", "cluster_id").collect())
    assert done == whole
    assert embed != "raw" or [r[1] for r in done[-3:]] == [-1] * 3


def test_information_counts_all_rows(spark):
    x, y = blobs(150, 6)
    x = np.concatenate([x, np.tile(x[:1], (200, 1)), [[3, 3, 3], [3.1, 3, 3.2], [9, 9, 9]]])  # a group of copies, a class of two, one of one
    y = np.concatenate([y, np.zeros(200, int), [3, 3, 4]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(cluster_id=y))
    whole, wide = ({r["feature"]: r["mi"] for r in cluster.information(df, NAMES, most=most).collect()} for most in (10_000, 100))
    assert whole.keys() == wide.keys() and all(abs(whole[f] - wide[f]) < 0.02 for f in NAMES)
    plain = df.dropDuplicates(NAMES)
    whole, wide = ({r["feature"]: r["mi"] for r in cluster.information(plain, NAMES, most=most).collect()} for most in (10_000, 100))
    assert all(abs(whole[f] - wide[f]) < 1e-6 for f in NAMES)


def test_memory_of_a_task_follows_no_square(monkeypatch):
    x = np.random.default_rng(5).normal(size=(3000, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    monkeypatch.setattr(cluster, "BLOCK_CELLS", 100_000)
    tracemalloc.start()
    ids, far = cluster.neighbors(x, 8)
    core, totals = cluster.core_distances(x, 8), cluster.distance_totals(x, np.arange(3000) % 2)
    tree = cluster._tree(x, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6
    assert (ids[:, 0] == np.arange(3000)).all() and np.allclose(far, np.sort(d, 1)[:, :8], atol=1e-6) and (core == far[:, -1]).all()
    assert np.allclose(totals, np.stack([d[:, ::2].sum(1), d[:, 1::2].sum(1)], 1)) and len(tree) == 2999


def _points():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 3)) * 12
    yield "noise", rng.normal(size=(1500, 3)), 20
    yield "blobs", np.concatenate([c + rng.normal(0, s, (300, 3)) for c, s in zip(centers, (0.3, 0.6, 0.9, 1, 1, 1.5), strict=True)]), 10
    yield "copies", np.concatenate([np.repeat(centers, 200, 0), np.tile(rng.normal(size=(100, 3)), (3, 1))]), 10
    yield "grid", np.stack(np.meshgrid(*[np.arange(11.0)] * 3), -1).reshape(-1, 3), 8


@pytest.mark.parametrize("name, x, k", list(_points()), ids=lambda v: v if isinstance(v, str) else "")
@pytest.mark.parametrize("basins", [2000, 1])
def test_tree_of_basins_is_a_minimum_spanning_tree(monkeypatch, spark, name, x, k, basins):
    cells, at = [], cluster.Boxes.distances

    def counted(self, rows, columns):
        cells.append(len(rows) * len(columns))
        return at(self, rows, columns)

    monkeypatch.setattr(cluster, "LEAF", 32)
    monkeypatch.setattr(cluster, "MOST_BASINS", basins)
    monkeypatch.setattr(cluster.Boxes, "distances", counted)
    monkeypatch.setattr(cluster.Wide, "over", lambda self, tasks, each, schema: pd.concat([each(i) for i in range(tasks)]))
    plain, edges = cluster._tree(x, k), cluster.Wide(spark).tree(x, k)
    n = len(x)
    if basins > 1:
        assert len(edges) == n - 1 and np.allclose(edges[:, 2], plain[:, 2], atol=1e-6)
        assert sum(cells) < (0.7 if name == "blobs" else 1.2) * n * n
    parent = list(range(n))
    weights = []
    for u, v, d in edges:
        u, v = int(u), int(v)
        while parent[u] != u:
            u = parent[u]
        while parent[v] != v:
            v = parent[v]
        if u != v:
            parent[u] = v
            weights.append(d)
    assert np.allclose(weights, plain[:, 2], atol=1e-6)


def test_wide_tree_in_tasks(spark):
    x, _ = blobs(400, 9)
    edges = cluster.Wide(spark).tree(x, 15)
    assert len(edges) == len(x) - 1 and np.allclose(edges[:, 2], cluster._tree(x, 15)[:, 2], atol=1e-9)
