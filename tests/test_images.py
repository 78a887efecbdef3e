"""Kernels and image tables on tiny PNGs."""

import numpy as np
import pytest

from tests.pngs import write_png
from tesserae.functions import kernels
from tesserae.operators import dedup, histogram, quality
from tesserae.plans import pixel_queries
from tesserae.sources import images


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    sharp = np.full((128, 128), 128)
    sharp[rng.integers(0, 128, 200), rng.integers(0, 128, 200)] = 255
    blurry = np.rint(kernels.gaussian(sharp / 255.0, 31) * 255)
    red = np.zeros((64, 64, 3)) + [200, 30, 40]
    blue = np.zeros((64, 64, 3)) + [30, 40, 200]
    gradient = np.tile(np.arange(64) * 4, (64, 1))
    clear = np.zeros((32, 32, 4)) + [10, 200, 30, 0]
    for name, a in (("sharp", sharp), ("blurry", blurry), ("red", red), ("blue", blue), ("gradient", gradient), ("clear", clear), ("red_again", red)):
        write_png(at / f"{name}.png", a)
    (at / "broken.jpg").write_bytes(b"not an image" * 20)
    (at / "tiny.png").write_bytes(b"x")
    (at / "notes.txt").write_text("no image" * 50)
    return str(at)


def by_name(df, *cols):
    return {r["path"].rsplit("/", 1)[1].split(".")[0]: r for r in df.collect()}


def test_scan_takes_image_files_only(spark, folder):
    names = [r["filename"] for r in images.scan(spark, [folder, folder + "/missing"]).collect()]
    assert names == sorted(names) and "notes.txt" not in names and "tiny.png" not in names and "broken.jpg" in names


def test_features_and_errors(spark, folder):
    good, bad = images.split_errors(images.feature_table(images.read(spark, [folder])))
    rows = by_name(good)
    assert len(good.columns) == 17
    assert any(r["path"].endswith("broken.jpg") for r in bad.collect())
    assert rows["red"]["warm_cool_bias"] > 0.5 > -0.5 > rows["blue"]["warm_cool_bias"]
    assert all(np.isfinite(v) for r in rows.values() for v in r[1:])


def test_histograms(spark, folder):
    good, _ = images.split_errors(images.histogram_bank(images.read(spark, [folder])))
    rows = by_name(good)
    for r in rows.values():
        assert abs(sum(r["brightness_hist"]) - 1) < 1e-9 and abs(sum(r["saturation_hist"]) - 1) < 1e-9
    assert not rows["gradient"]["hue_valid"] and sum(rows["gradient"]["hue_hist"]) == 0
    assert np.argmax(rows["red"]["hue_hist"]) == 23 and 14 <= np.argmax(rows["blue"]["hue_hist"]) <= 16
    summary = {r["path"].rsplit("/", 1)[1]: r for r in histogram.channel(good).collect()}
    assert "warm" in summary["red.png"]["labels"] or summary["red.png"]["hue_dominant_bin"] == 23
    z = histogram.residuals(good, "brightness_hist", 16).select("brightness_hist_z").collect()
    assert abs(np.mean([r[0] for r in z])) < 1e-6


def test_quality_orders(spark, folder):
    good, _ = images.split_errors(images.quality_table(images.read(spark, [folder])))
    rows = by_name(good)
    assert rows["blurry"]["blur_laplacian_var"] < rows["sharp"]["blur_laplacian_var"]
    assert rows["red"]["edge_density"] == 0
    channel = quality.channel(good.withColumnRenamed("path", "image_path"))
    assert sum(r["is_blurry_candidate"] for r in channel.collect()) <= 2
    assert all(("blurry" in r["labels"]) == r["is_blurry_candidate"] for r in channel.collect())


def test_metadata(spark, folder):
    rows = by_name(images.split_errors(images.metadata_table(images.read(spark, [folder])))[0])
    assert rows["clear"]["has_alpha"] and rows["clear"]["transparent_ratio"] == 1.0
    assert rows["sharp"]["orientation"] == "square" and rows["sharp"]["megapixels"] == round(128 * 128 / 1e6, 4)


def test_hashes_group_copies_only(spark, folder):
    good, _ = images.split_errors(images.hash_table(images.read(spark, [folder])))
    groups = dedup.perceptual_groups(good.withColumnRenamed("path", "id"), dedup.PairRule()).collect()
    members = {r["id"].rsplit("/", 1)[1] for r in groups}
    assert {"red.png", "red_again.png"} <= members


def test_depth(spark, tmp_path):
    far = np.tile(np.arange(40) * 6, (40, 1))
    write_png(tmp_path / "a.png", far)
    write_png(tmp_path / "a_depth.png", far)
    read = images.read(spark, [str(tmp_path)])
    pairs = images.depth_pairs(read.where("path NOT LIKE '%_depth.png'"), read.where("path LIKE '%_depth.png'")).collect()
    assert len(pairs) == 1 and pairs[0]["depth_variance"] > 0


def test_area_resize_keeps_means():
    a = np.random.default_rng(2).random((50, 70))
    assert abs(kernels.area_resize(a, 7, 9).mean() - a.mean()) < 1e-9
    assert np.allclose(kernels.area_resize(a, 50, 70), a)


def test_coupling_and_legacy():
    rng = np.random.default_rng(3)
    rgb = rng.random((40, 40, 3))
    assert len(kernels.legacy_vector(rgb)) == 11
    r, _ = kernels.coupling(rgb, kernels.luma(rgb))
    assert r > 0.99


def test_legacy_warm_cool_is_red_less_blue():
    rgb = np.zeros((4, 4, 3))
    rgb[:2, :, 0], rgb[2:, :, 2] = 1.0, 0.5
    assert kernels.legacy_warm_cool(rgb) == 0.25


def test_stacks_measure_as_single_images_do(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, (w, h, c) in enumerate([(8, 8, 3), (1, 1, 3), (9, 5, 4), (8, 8, 3), (40, 30, 1), (8, 8, 3)] * 3):
        data = np.zeros((h, w, c), np.uint8) if k < 4 else rng.integers(0, 256, (h, w, c), np.uint8)
        rows.append((f"/p{k}", w, h, c, bytearray(data.tobytes())))
    rows += [("/bad", -1, -1, -1, bytearray()), ("/none", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, width int, height int, nChannels int, data binary").coalesce(1)
    groups = {"brightness": tuple("abcde"), "lighting": tuple("fghi"), "color": tuple("jklmnop"), "spatial_lighting": tuple("qrstu"), "subject_bg": ("v",)}
    for table in (lambda x: images.feature_table(x, groups), images.histogram_bank, images.quality_table, images.shapes_and_metadata, images.hash_table):
        flat = lambda r: np.hstack([np.ravel(v) for v in r[1:] if isinstance(v, int | float | list)])
        whole = {r["path"]: r for r in table(df).collect()}
        assert len(whole) == len(rows) and {p for p, r in whole.items() if r["error"]} == {"/bad", "/none"}
        for p in ("/p2", "/p4", "/p8", "/p10"):
            one = table(df.where(f"path = '{p}'")).first()
            assert np.allclose(flat(one), flat(whole[p]), atol=1e-12)
    stacked = list(images.stacks(df.where("width = 8").toPandas()))
    assert [rgb.shape for _, rgb, _ in stacked] == [(9, 8, 8, 3)]


def test_pictures_are_dealt_by_their_number(spark, tmp_path):
    spark.range(0, 20_001, 1, 1).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    assert pixel_queries.pictures(spark, str(tmp_path)).rdd.getNumPartitions() == 5
    spark.range(0).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "none/part.parquet"))
    assert pixel_queries.features(spark, str(tmp_path / "none")).count() == 0
