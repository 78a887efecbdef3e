"""Snapshot logs, previews, copying exports and the feature cache on real folders."""

import hashlib
import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import export
from tesserae.sources import copies, images, storage
from tesserae.sources.feature_cache import FeatureCache
from tesserae.sources.previews import ManualEdits, Previews
from tesserae.sources.snapshots import Conflict, SnapshotLog
from tests.pngs import write_png

# ---- storage and snapshots --------------------------------------------------------------------------------------


def test_publish_is_for_one_writer_only(spark, tmp_path):
    at, won = f"{tmp_path}/a b/x.json", []

    def write(k):
        try:
            storage.publish(spark, at, f"é{k}")
            won.append(k)
        except storage.Taken:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and storage.read_text(spark, at) == f"é{won[0]}"
    assert storage.names(spark, f"{tmp_path}/a b") == ["x.json"]


def test_opened_knows_hadoop_schemes(tmp_path):
    (tmp_path / "a b").write_bytes(b"x")
    for uri in (f"{tmp_path}/a b", f"file:{tmp_path}/a%20b", f"file://{tmp_path}/a%20b"):
        store, at = storage.opened(uri)
        assert store.get_file_info(at).size == 1


def test_snapshot_log(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path))
    assert log.version().number == 0 and log.read("t") is None and log.history() == []
    one = log.commit(log.version(), "build", {"t": log.put(spark.range(3))})
    two = log.commit(one, "build", {"t": log.put(spark.range(5))}, {"n": 5})
    assert (log.read("t").count(), log.read("t", one).count(), two.number) == (5, 3, 2)
    with pytest.raises(Conflict):
        log.commit(one, "build", {})
    back = log.rollback(1)
    assert (back.number, log.read("t").count()) == (3, 3)
    assert [v.kind for v in log.history()] == ["build", "build", "rollback"]
    orphan = log.put(spark.range(1))  # a writer that died before its commit
    assert log.vacuum(keep=1) == sorted([two.tables["t"], orphan])
    assert log.read("t").count() == 3


def test_of_two_writers_from_one_version_one_fails(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path))
    base, done = log.version(), []
    tables = [{"t": log.put(spark.range(k + 1))} for k in range(4)]

    def commit(k):
        try:
            done.append((k, log.commit(base, "build", tables[k]).number))
        except Conflict:
            done.append((k, None))

    threads = [threading.Thread(target=commit, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [k for k, n in done if n == 1]
    assert len(done) == 4 and len(won) == 1 and log.read("t").count() == won[0] + 1


# ---- previews ---------------------------------------------------------------------------------------------------


def points(spark, labels):
    return spark.createDataFrame([(f"i{k}", c, 0.5 * k) for k, c in enumerate(labels)], "image_id string, cluster_id int, umap_x double")


def test_previews(spark, tmp_path):
    p = Previews(spark, str(tmp_path))
    a = p.create(points(spark, [0, 0, 1, -1]), {"n_neighbors": 5, "embedding": [1]}, {"silhouette": 0.4}, "a")
    got = p.get(a)
    assert got["recipe"] == {"n_neighbors": 5} and got["metrics"]["base_version"] == 0 and got["metrics"]["risks"] == ["warning:largest"]
    assert sorted(map(tuple, got["summary"].collect())) == [(0, 2, 0.5), (1, 1, 0.25)]
    assert sorted(map(tuple, got["names"].collect())) == [(0, "cluster_000"), (1, "cluster_001")]
    assert p.labels() is None
    p.apply(a)
    assert p.labels().count() == 4
    b = p.create(points(spark, [1, 1, 1, 1]), {}, {}, "b")
    got = p.get(b)
    assert sorted(map(tuple, got["diff"].collect())) == [(-1, 1, 1), (0, 1, 2), (1, 1, 1)]
    assert "error:changed" in got["metrics"]["risks"]
    assert p.names() == ["a", "b"]
    with pytest.raises(KeyError):
        p.get("c")
    os.makedirs(tmp_path / "previews" / "half" / "points")  # one that was never finished
    assert p.names() == ["a", "b"]


def test_applying_needs_force_over_edits_and_clears_them(spark, tmp_path):
    p = Previews(spark, str(tmp_path))
    p.create(points(spark, [0, 1]), {}, {}, "a")
    p.create(points(spark, [1, 1]), {}, {}, "b")
    p.apply("a")
    schema = "image_id string, cluster_id int, cluster_name string, seq long"
    p.edit(spark.createDataFrame([("i0", 7, None, 1), ("i0", 8, None, 2)], schema))
    edited = p.edit(spark.createDataFrame([("i0", None, "mine", 3)], schema))
    assert list(map(tuple, p.edits().collect())) == [("i0", 8, "mine")]
    with pytest.raises(ManualEdits):
        p.apply("b")
    assert p.labels().where("image_id = 'i0'").first()["cluster_id"] == 0
    p.apply("b", force=True)
    assert p.edits().isEmpty() and p.labels().where("image_id = 'i0'").first()["cluster_id"] == 1
    p.rollback(edited.number)
    assert p.edits().count() == 1 and p.labels().where("image_id = 'i0'").first()["cluster_id"] == 0


def test_of_two_applies_one_fails_and_failures_leave_the_labels(spark, tmp_path, monkeypatch):
    p = Previews(spark, str(tmp_path))
    for name, labels in (("a", [0, 1]), ("b", [1, 1]), ("c", [2, 2])):
        p.create(points(spark, labels), {}, {}, name)
    p.apply("a")
    seen = p.log.version()
    p.apply("b", base=seen)
    with pytest.raises(Conflict):
        p.apply("c", base=seen)
    for step in ("put", "commit"):
        with monkeypatch.context() as m:
            m.setattr(p.log, step, lambda *a, **b: (_ for _ in ()).throw(OSError("disk")))
            with pytest.raises(OSError):
                p.apply("c")
        assert {r["cluster_id"] for r in p.labels().collect()} == {1}
    p.apply("c")
    assert {r["cluster_id"] for r in p.labels().collect()} == {2}


# ---- copying exports --------------------------------------------------------------------------------------------


@pytest.fixture
def files(tmp_path):
    for k in range(12):
        at = tmp_path / "in" / f"d{k % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k // 3}.jpg").write_bytes(f"content {k}".encode() * (k * 1000 + 1))
    return tmp_path / "in"


def the_plan(spark, files):
    rows = [(k, f"{files}/d{k % 3}/{k // 3}.jpg", k % 2, "ab", k) for k in range(12)]
    df = spark.createDataFrame(rows, "image_id long, path string, cluster_id int, cluster_name string, position long")
    return export.by_cluster(df)


def on_disk(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_export_copies_under_unique_names_and_records_once(spark, files, tmp_path):
    plan, out, log = the_plan(spark, files), tmp_path / "out", f"{tmp_path}/records"
    record = copies.export(plan, str(out), [str(files)], log, "e1", tasks=3)
    assert record["exported_count"] == 12 and record["failed"] == [] and record["counts"] == {"copied": 12}
    want = {r["target"]: open(r["path"], "rb").read() for r in plan.collect()}
    assert on_disk(out) == want and any("_1.jpg" in t for t in want)
    rows = copies.record_rows(spark, log, "e1").collect()
    assert sorted(r["target"] for r in rows) == sorted(want)
    assert all(r["sha256"] == hashlib.sha256(want[r["target"]]).hexdigest() and r["bytes"] == len(want[r["target"]]) for r in rows)
    assert [r["export_id"] for r in copies.records(spark, log)] == ["e1"]
    assert copies.export(plan, str(out), [str(files)], log, "e1") == record


def test_export_that_was_killed_half_way_is_finished(spark, files, tmp_path):
    plan, out, log = the_plan(spark, files), tmp_path / "out", f"{tmp_path}/records"
    copies.copy(plan.where("image_id < 5"), str(out), [str(files)]).collect()
    (out / ".copying").mkdir(exist_ok=True)
    (out / ".copying" / "9-dead").write_bytes(b"half a fi")  # what a killed attempt leaves
    record = copies.export(plan, str(out), [str(files)], log, "e1")
    assert record["counts"] == {"copied": 7, "present": 5} and record["exported_count"] == 12
    assert on_disk(out) == {r["target"]: open(r["path"], "rb").read() for r in plan.collect()}
    assert copies.record_rows(spark, log, "e1").groupBy("target").count().where("count > 1").isEmpty()


def test_export_overwrites_nothing_and_stays_inside(spark, files, tmp_path):
    (tmp_path / "secret.txt").write_bytes(b"secret")
    out = tmp_path / "out"
    out.mkdir()
    (out / "taken.jpg").write_bytes(b"mine")
    rows = [
        (1, "1", f"{files}/d0/0.jpg", "taken.jpg"), (2, "2", f"{tmp_path}/secret.txt", "a.jpg"), (3, "3", f"{files}/../secret.txt", "b.jpg"), (4, "4", f"{files}/d0/0.jpg", "../c.jpg"),
        (5, "5", f"{files}/d0/none.jpg", "d.jpg"), (6, "6", f"{files}/d0", "e.jpg"), (7, "7", None, "f.jpg"), (8, "8", f"{files}/d1/0.jpg", "x/./y/../ok.jpg"), (9, "9", f"file:{files}/d2/0.jpg", "uri.jpg"),
    ]
    plan = spark.createDataFrame(rows, "rank int, image_id string, path string, target string")
    record = copies.export(plan, str(out), [str(files)], f"{tmp_path}/records", "e")
    got = {r["image_id"]: r["status"] for r in copies.record_rows(spark, f"{tmp_path}/records", "e").collect()}
    assert got == {"1": "conflict", "2": "outside", "3": "outside", "4": "outside", "5": "missing", "6": "missing", "7": "outside", "8": "copied", "9": "copied"}
    assert sorted(on_disk(out)) == ["taken.jpg", "uri.jpg", "x/ok.jpg"] and (out / "taken.jpg").read_bytes() == b"mine"
    assert not (tmp_path / "c.jpg").exists() and record["failed_count"] == 7 and len(record["failed"]) == 7


def test_export_folder_is_new(spark, tmp_path):
    assert copies.new_folder(spark, str(tmp_path), "e") == f"{tmp_path}/e"
    for n in ("e", "e_001"):
        (tmp_path / n).mkdir()
    assert copies.new_folder(spark, str(tmp_path), "e") == f"{tmp_path}/e_002"


# ---- feature cache ----------------------------------------------------------------------------------------------


def test_feature_cache_decodes_new_contents_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    draw = lambda name, seed: write_png(src / f"{name}.png", np.random.default_rng(seed).integers(0, 255, (16, 16)))
    for k in range(40):
        draw(f"a{k:02d}", k)
    draw("copy", 3)
    seen = []

    def compute(paths):
        seen.append(sorted(os.path.basename(r["path"]) for r in paths.collect()))
        return images.feature_table(images.read_paths(spark, paths)).where("error IS NULL").drop("error")

    def refresh(cache):
        table, how = cache.refresh(images.scan(spark, [str(src)]), compute)
        names = [c for c in table.columns if c not in ("path", "modificationTime", "length", "content_hash")]
        return {os.path.basename(r["path"]): tuple(r[n] for n in names) for r in table.collect()}, how

    cache = FeatureCache(spark, f"{tmp_path}/cache", {"groups": ["brightness"]})
    first, how = refresh(cache)
    assert (len(first), how["read"], how["decoded"]) == (41, 41, 40) and first["copy.png"] == first["a03.png"]
    for k in range(3):
        draw(f"b{k}", 100 + k)
    draw("a00", 200)  # another content under an old name
    os.remove(src / "a01.png")
    os.utime(src / "a02.png", (1, 1))  # touched, not changed
    second, how = refresh(cache)
    assert (how["read"], how["decoded"]) == (5, 4) and seen[1] == ["a00.png", "b0.png", "b1.png", "b2.png"]
    full, _ = refresh(FeatureCache(spark, f"{tmp_path}/other", {}))
    assert second == full and "a01.png" not in second and len(second) == 43
    again, how = refresh(cache)
    assert again == second and (how["read"], how["decoded"]) == (0, 0)
    before = cache.features().count()
    cache.compact()
    assert cache.features().count() == before - 2  # the contents of a00 before and of a01 are gone
    assert refresh(cache)[0] == second


def test_feature_cache_survives_a_failed_computation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_png(tmp_path / "in" / "a.png", np.random.default_rng(1).integers(0, 255, (16, 16)))
    cache, files = FeatureCache(spark, f"{tmp_path}/cache", {}), images.scan(spark, [f"{tmp_path}/in"])

    def broken(paths):
        raise ValueError("no decoder")

    with pytest.raises(ValueError):
        cache.refresh(files, broken)
    table, how = cache.refresh(files, lambda paths: paths.select("path", F.lit(1.0).alias("x")))
    assert how["decoded"] == 1 and table.first()["x"] == 1.0
    with pytest.raises(Conflict):
        cache.log.commit(cache.log.version(how["version"] - 1), "refresh", {})
    assert json.loads(storage.read_text(spark, cache.log._entry(how["version"])))["note"]["decoded"] == 1
