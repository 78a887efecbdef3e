"""Thumbnails against a plain average, and what a second run writes."""

import os

import numpy as np
from pyspark.sql import functions as F

from tesserae.sources import images, thumbnails
from tests.pngs import write_png


def test_thumbnails_are_written_once_and_again_when_touched(spark, tmp_path):
    src, root = tmp_path / "in", tmp_path / "thumbs"
    src.mkdir()
    pixels = {f"{k}.png": np.random.default_rng(k).integers(0, 255, (40 + 8 * k, 64)) for k in range(6)}
    for n, p in pixels.items():
        write_png(src / n, p)
    (src / "bad.png").write_bytes(b"x" * 500)
    scan = lambda: images.scan(spark, [str(src)])
    table, n = thumbnails.refresh(spark, scan(), str(root), side=32)
    rows = {os.path.basename(r["path"]): r for r in table.collect()}
    assert n == 7 and rows["bad.png"]["error"] and rows["bad.png"]["name"] is None
    files = {r["name"] for b, r in rows.items() if b != "bad.png"}
    stamp = lambda: {f: os.stat(root / f).st_mtime_ns for f in os.listdir(root) if f.endswith(".png")}
    before = stamp()
    assert set(before) == files and max(rows["0.png"]["thumb_width"], rows["5.png"]["thumb_height"]) <= 32
    again, n = thumbnails.refresh(spark, scan(), str(root), side=32)
    assert n == 0 and stamp() == before and again.count() == 7
    os.utime(src / "2.png", (5, 5))
    os.remove(src / "3.png")
    write_png(src / "new.png", pixels["1.png"])
    table, n = thumbnails.refresh(spark, scan(), str(root), side=32)
    after, names = stamp(), {os.path.basename(r["path"]): r["name"] for r in table.collect()}
    changed = {f for f in after if after[f] != before.get(f)}
    assert n == 2 and changed == {names["2.png"], names["new.png"]} and "3.png" not in names and len(names) == 7


def test_a_thumbnail_is_the_average_of_areas(spark, tmp_path):
    (tmp_path / "in").mkdir()
    grey = np.random.default_rng(1).integers(0, 255, (64, 64))
    write_png(tmp_path / "in" / "a.png", grey)
    table, _ = thumbnails.refresh(spark, images.scan(spark, [f"{tmp_path}/in"]), f"{tmp_path}/t", side=16)
    back = images.read(spark, [f"{tmp_path}/t/{table.first()['name']}"]).first()
    assert (back["width"], back["height"], back["nChannels"]) == (16, 16, 3)
    got = np.frombuffer(back["data"], np.uint8).reshape(16, 16, 3)
    want = grey.reshape(16, 4, 16, 4).mean(axis=(1, 3))
    assert np.abs(got - want[..., None]).max() <= 1.0


def test_first_of_clusters_limits_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.format_string("p%05d", "id").alias("path"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).cast("int").alias("cluster_id"))
    got = thumbnails.first_of_clusters(rows)
    held = {}
    for r in rows.collect():
        held.setdefault(r["cluster_id"], []).append(r["path"])
    assert {(r["cluster_id"], r["place"], r["path"]) for r in got.collect()} == {(c, k, p) for c, ps in held.items() for k, p in enumerate(sorted(ps)[:16], 1)}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
