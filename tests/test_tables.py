"""Label rules, calibration, overlays, tables on disk, streams."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.pngs import write_png
from tesserae.functions import grams, labels, scalars
from tesserae.functions.config import LabelConfig
from tesserae.operators import calibrate, dedup, export, graph, histogram, overlay, slices, stats
from tesserae.plans import queries, views
from tesserae.sources import tables
from tesserae.streaming import ingest


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(42)
    n = 200
    u = lambda: rng.random(n)
    df = pd.DataFrame({
        "image_id": [f"i{i}" for i in range(n)], "brightness_dark_ratio": u() * 0.6, "brightness_bright_ratio": 0.2 + u() * 0.6, "brightness_entropy": 2 + u() * 2.5,
        "saturation_low_ratio": u() * 0.8, "saturation_high_ratio": u() * 0.5, "hue_warm_ratio": u() * 0.8, "hue_cool_ratio": u() * 0.8, "hue_entropy": 2 + u() * 2.5, "hue_valid": True, "s": [f"d{i % 3}" for i in range(n)],
    })
    return spark.createDataFrame(df)


def test_masks_match_pandas(frame):
    pdf = frame.toPandas()
    rules = labels.masks()
    got = frame.select(*(v.alias(k) for k, v in rules.items())).toPandas()
    assert (got["low_key"] == (pdf.brightness_dark_ratio > 0.4144)).all() and (got["flat_light"] == (pdf.brightness_entropy < 3.0)).all()
    assert not frame.select(labels.masks(has_hue=False)["warm"].alias("w")).where("w").count()


def test_coarse_calibration_reaches_targets(frame):
    tuned = calibrate.coarse(frame)
    rates = {r["label"]: r["rate"] for r in calibrate.label_rates(frame, tuned).collect()}
    assert 0.05 <= rates["low_key"] <= 0.30 and 0.05 <= rates["muted"] <= 0.40
    assert calibrate.penalty(frame, tuned) <= calibrate.penalty(frame, LabelConfig())
    assert isinstance(calibrate.recommendation(frame, LabelConfig(), tuned), list)


def test_coarse_calibration_moves_both_kinds_of_rules_the_right_way(spark):
    rows = [(k / 1000, 2 + 2 * k / 1000, None if k % 2 else k / 1000) for k in range(1000)]
    df = spark.createDataFrame(rows, "brightness_dark_ratio double, brightness_entropy double, hue_warm_ratio double")
    for f in ("brightness_bright_ratio", "saturation_low_ratio", "saturation_high_ratio", "hue_cool_ratio", "hue_entropy"):
        df = df.withColumn(f, F.lit(None).cast("double"))
    start = LabelConfig(low_key_dark_ratio=0.999, flat_light_entropy=2.02, warm_ratio=0.1)
    tuned = calibrate.coarse(df, start, {"low_key": (0.1, 0.3), "flat_light": (0.05, 0.3), "warm": (0.05, 0.2)})
    rate = lambda f, t, above: calibrate.hit_rates(df, f, [t], above)[0]
    assert rate("brightness_dark_ratio", tuned.low_key_dark_ratio, True) == pytest.approx(0.1, abs=0.002)
    assert rate("brightness_entropy", tuned.flat_light_entropy, False) == pytest.approx(0.05, abs=0.002)
    assert rate("hue_warm_ratio", tuned.warm_ratio, True) == pytest.approx(0.2, abs=0.002)
    assert tuned.cool_ratio == start.cool_ratio  # a field without values says nothing
    assert calibrate.coarse(df.limit(0), start) == start


def rates_by_numpy(pdf, configs, source=None):
    out = []
    for k, c in enumerate(configs):
        groups = [(None, pdf)] + (list(pdf.groupby(source)) if source else [])
        for name, g in groups:
            m = {
                "low_key": g.brightness_dark_ratio > c.low_key_dark_ratio, "high_key": g.brightness_bright_ratio > c.high_key_bright_ratio,
                "high_contrast": (g.brightness_dark_ratio > c.high_contrast_dark_ratio) & (g.brightness_bright_ratio > c.high_contrast_bright_ratio),
                "flat_light": g.brightness_entropy < c.flat_light_entropy, "muted": g.saturation_low_ratio > c.muted_low_sat_ratio, "vivid": g.saturation_high_ratio > c.vivid_high_sat_ratio,
                "warm": g.hue_warm_ratio > c.warm_ratio, "cool": g.hue_cool_ratio > c.cool_ratio, "mixed_color": g.hue_entropy > c.mixed_color_entropy,
            }
            none = ~np.logical_or.reduce([v.to_numpy() for v in m.values()])
            line = (g.brightness_bright_ratio > c.lineart_bright_ratio) & (g.saturation_low_ratio > c.lineart_low_sat_ratio) & (g.brightness_dark_ratio > c.lineart_dark_ratio)
            m |= {"lineart_like_candidate": line, "unclassified": none, "warm_and_cool": m["warm"] & m["cool"]}
            out += [(k, name, n, float(np.mean(v))) for n, v in m.items()]
    return out


def test_rates_of_several_configurations_in_one_scan(frame):
    configs = [LabelConfig(), LabelConfig(warm_ratio=0.2, flat_light_entropy=3.5, lineart_dark_ratio=0.1)]
    for source in (None, "s"):
        got = {(r["config"], r["s"] if source else None, r["label"]): r["rate"] for r in calibrate.config_rates(frame, configs, source).collect()}
        want = {x[:3]: x[3] for x in rates_by_numpy(frame.toPandas(), configs, source)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_parzen_search_beats_uniform_search(frame, monkeypatch):
    pdf, scans = frame.toPandas(), []

    def penalties(df, configs, targets, base=None, source=None, weights=None):
        scans.append(len(configs))
        found = [{} for _ in configs]
        for k, s, label, rate in rates_by_numpy(pdf, configs, source):
            found[k].setdefault(s, {})[label] = rate
        return [calibrate._penalty(c, r, targets, base, weights or {}) for c, r in zip(configs, found, strict=True)]

    start = LabelConfig()
    targets = {"low_key": (0.02, 0.04), "high_key": (0.60, 0.65), "muted": (0.28, 0.30), "vivid": (0.70, 0.75), "warm": (0.45, 0.5), "cool": (0.02, 0.04), "mixed_color": (0.30, 0.33)}
    space = {n: (0.02, 0.98) for n in calibrate.REACH} | {"mixed_color_entropy": (2.0, 4.5)}
    spark_scores = [calibrate.penalties(frame, [start], targets, start), calibrate.penalties(frame, [start], targets, start, "s")]
    monkeypatch.setattr(calibrate, "penalties", penalties)
    assert spark_scores == [penalties(frame, [start], targets, start), penalties(frame, [start], targets, start, "s")]
    means = {}
    for sampler in ("parzen", "uniform"):
        scores = []
        for seed in range(10):
            scans.clear()
            scores.append(calibrate.search(frame, start, targets, trials=40, seed=seed, space=space, sampler=sampler)[1])
            assert len(scans) <= 5 and sum(scans) == 41
        means[sampler] = sum(scores) / 10
    assert means["parzen"] < 0.8 * means["uniform"]


def test_search_by_spark_is_never_worse_than_its_start(frame):
    best, score = calibrate.search(frame, LabelConfig(), trials=6, batch=3, source="s")
    assert score <= calibrate.penalty(frame, LabelConfig(), base=LabelConfig(), source="s")
    assert score == calibrate.penalty(frame, best, base=LabelConfig(), source="s")
    assert calibrate.search(frame, LabelConfig(), trials=0)[0] == LabelConfig()


def test_merged_config_drops_unknown_keys():
    assert LabelConfig.merged({"warm_ratio": 0.3, "gone": 1}).warm_ratio == 0.3


def test_strict_and_substring_labels(spark):
    df = spark.createDataFrame([("high_contrast_v2",), ("high_contrast;x",)], "labels string")
    assert df.where(labels.has_label(F.col("labels"), "high_contrast")).count() == 1
    assert df.where(labels.has_label(F.col("labels"), "high_contrast", strict=False)).count() == 2


def test_hamming(spark):
    df = spark.createDataFrame([("0000", "0000"), ("ffff", "0000"), ("", "00"), (None, "0")], "a string, b string")
    assert [r[0] for r in df.select(scalars.hamming_hex(F.col("a"), F.col("b"))).collect()] == [0, 16, 999, 999]


def test_empty_hashes_make_no_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", 5)], "id string, phash long")
    assert dedup.perceptual_groups(df, dedup.PairRule((("phash", 6),), 1)).count() == 0


def test_chains_are_one_component(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a int, b int")
    roots = {r["id"]: r["root"] for r in dedup.components(edges).collect()}
    assert {roots[i] for i in range(n + 1)} == {0} and roots[101] == 100


def test_page_rejects_unknown_field(frame):
    with pytest.raises(ValueError):
        slices.page(frame, {"hue_entropy"}, "evil")
    rows, total = slices.page(frame, {"hue_entropy"}, "hue_entropy", limit=5, offset=3, key="image_id")
    assert total == 200 and rows.count() == 5


def test_tables_and_channels(spark, tmp_path, frame):
    root = str(tmp_path)
    assert tables.read_table(spark, [root + "/none"], "a int").count() == 0
    df, how = tables.build_channel(spark, root + "/ch", lambda: frame)
    assert how == "built" and tables.build_channel(spark, root + "/ch", lambda: frame)[1] == "already_ready" and df.count() == 200
    tables.write_csv(frame.select("image_id", F.array(F.lit("x"), F.lit("y")).alias("t")), root + "/csv")
    assert spark.read.option("header", True).csv(root + "/csv").first()["t"] == "x;y"


def test_index_normalisation(spark):
    df = spark.createDataFrame([("a\\b c.png", 3, 4)], "image_path string, width int, height int")
    row = tables.normalize_index(df).first()
    assert row["relative_path"] == "a/b c.png" and row["filename"] == "b c.png"
    assert spark.createDataFrame([(row["image_id"],)], "i string").select(scalars.image_path(F.col("i"))).first()[0] == "a/b c.png"


def test_stream_takes_each_content_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n, v in (("a", 1), ("b", 1), ("c", 2)):
        write_png(src / f"{n}.png", np.random.default_rng(v).integers(0, 255, (20, 20)))
    stream = ingest.distinct_contents(ingest.arrivals(spark, str(src)))
    ingest.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_localized_names(spark):
    from tesserae.operators.experiments import localized

    df = spark.createDataFrame([("high_key_warm_side_light",), ("noise",), ("my_name",)], "n string")
    assert [r[0] for r in df.select(localized(F.col("n"))).collect()] == ["侧光 · 高调 · 暖色", "未归类", "my name"]


def test_ranks_without_one_task(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "id * 7919 % 5003 AS k")
    got = [(r["k"], r["rank"]) for r in slices.ranked(rows, "k").collect()]
    assert [n for _, n in sorted(got)] == list(range(1, 5001))
    assert slices.ranked(rows.where("false"), "k").count() == 0


def test_cluster_and_explanatory_matrices(spark):
    df = spark.createDataFrame([(10.0, 1.0, 5.0, 7.0), (10.0, 2.0, 6.0, 8.0), (10.0, 3.0, 7.0, 9.0)], "a double, b double, c double, d double")
    groups = {"g": {"enabled": True, "dims": 2, "cluster": True, "weight": 2.0}, "e": {"enabled": True, "dims": 2, "cluster": False, "weight": 3.0}, "off": {"enabled": False}}
    cluster, explain = stats.split_matrix(df, groups, {"g": ("a", "b"), "e": ("c", "d")})
    assert cluster.columns == ["b"] and sorted(map(tuple, cluster.collect())) == [(2.0,), (4.0,), (6.0,)]
    assert sorted(map(tuple, explain.collect())) == [(5.0, 7.0), (6.0, 8.0), (7.0, 9.0)]


def test_paths_stay_inside_their_roots(spark):
    paths = ["data/a.png", "data/x/../a.png", "data/../etc/a", "database/a", "../data/a", "/data/a", "data", None, "data\\x\\a", "./data//a", "data/../../data/a"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    inside = [r[0] for r in df.select(export.contained(F.col("p"), ["data"])).collect()]
    assert inside == [True, True, False, False, False, False, False, False, True, True, False]
    assert [r[0] for r in df.select(export.contained(F.col("p"), ["/data/"])).collect()].count(True) == 1


def test_moves_of_a_log_and_names_of_rows(spark):
    rows = spark.createDataFrame([("o/a.png", "a.png", 1, "own"), ("o/b.png", "b.png", 2, "own b"), ("o/c.png", "c.png", 3, "")], "image_path string, filename string, cluster_id int, cluster_name string")
    moves = spark.createDataFrame([("a.png", 5, 1), ("a.png", 4, 2)], "alias string, target int, seq int")
    names = spark.createDataFrame([(5, "five")], "cluster_id int, display_name string")
    got = {r["filename"]: (r["cluster_id"], r["cluster_name"], r["original_cluster_name"]) for r in overlay.with_names(overlay.apply_moves(rows, moves), names).collect()}
    assert got == {"a.png": (4, "Cluster 4", "own"), "b.png": (2, "own b", "own b"), "c.png": (3, "Cluster 3", "Cluster 3")}


def test_a_page_falls_back_to_its_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "image_path string, x double")
    rows, total = slices.page(df, {"x"}, "nothing", fallback=True)
    assert [r["image_path"] for r in rows.collect()] == ["a", "b"] and total == 2


def test_few_hues_are_a_warning(spark):
    rates = spark.createDataFrame([("warm", 0.9), ("cool", 0.5)], "label string, rate double")
    assert {r["warning"] for r in calibrate.warnings(rates, 0.1).collect()} == {"too_loose", "few_hues"}
    assert {r["warning"] for r in calibrate.warnings(rates, 0.3).collect()} == {"too_loose"}


def test_quality_scores_without_a_histogram_row_or_value(spark):
    from tesserae.operators import quality

    q = spark.createDataFrame([("a", 0.1, 0.02), ("b", 0.1, 0.02), ("c", 0.1, 0.02)], "image_path string, edge_density double, local_contrast_p95 double")
    h = spark.createDataFrame([("a", 1.0, 0.0, 1.0), ("b", None, 0.3, 0.5)], "image_path string, brightness_bright_ratio double, brightness_dark_ratio double, saturation_low_ratio double")
    rows = {r["image_path"]: r for r in quality.scores(q, h).collect()}
    assert [rows[k]["_hist_found"] for k in "abc"] == [True, True, False]
    # a missing row and a missing value take the same default
    assert rows["b"]["lineart_score_v2"] == rows["c"]["lineart_score_v2"] == 0.415
    assert rows["a"]["lineart_score_v2"] == 0.785


@pytest.mark.parametrize("rule", [dedup.PairRule(), dedup.PairRule(min_hits=1), dedup.PairRule(min_hits=4), dedup.PairRule((("phash", 6),), 1, 60)])
def test_near_pairs_are_all_pairs_within_the_distances(spark, rule):
    """Copies with up to two bits too many turned, over all bits of hashes as wide as the kernels' ones; missing hashes hit nothing."""
    rng = random.Random(7)
    wide = {n: rule.width(n) for n in dedup.THRESHOLDS}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = []
    for _ in range(12):
        base = {n: rng.getrandbits(w) for n, w in wide.items()}
        for _ in range(8):
            turned = {n: sum(1 << b for b in rng.sample(range(wide[n]), rng.randint(0, t + 2))) for n, t in dedup.THRESHOLDS.items()}
            rows.append((len(rows), *(None if rng.random() < 0.05 else signed(base[n] ^ turned[n]) for n in wide)))
    got = {(r.a, r.b, r.hits) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} long" for n in wide)), rule).collect()}
    want = set()
    at = {n: i + 1 for i, n in enumerate(wide)}
    for x in rows:
        for y in rows[x[0] + 1 :]:
            hits = sum(x[at[n]] is not None and y[at[n]] is not None and ((x[at[n]] ^ y[at[n]]) & (2**64 - 1)).bit_count() <= t for n, t in rule.thresholds)
            if hits >= rule.min_hits:
                want.add((x[0], y[0], hits))
    assert want and got == want


def test_units_of_many_rows_are_dealt_as_chunks(spark, monkeypatch):
    """Near copies, so that all rows of a unit are near; three chunks or more of each must give each pair once."""
    rng = random.Random(3)
    rows = [(f"r{i:03d}", *(sum(1 << b for b in rng.sample(range(60), 2)) for _ in dedup.THRESHOLDS)) for i in range(90)]
    hashes = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} long" for n in dedup.THRESHOLDS))
    monkeypatch.setattr(dedup, "SIDE", 30)
    got = [(r.a, r.b) for r in dedup.near_pairs(hashes, queries.RULE).collect()]
    assert sorted(got) == [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0]]


@pytest.mark.parametrize("side", [30, 50_000])
def test_links_connect_what_pairs_connect(spark, monkeypatch, side):
    """Families of near copies: the same groups and evidence as by all pairs, by far fewer links."""
    rng = random.Random(11)
    rows = []
    for family in range(4):
        base = [rng.getrandbits(60) for _ in dedup.THRESHOLDS]
        for _ in range(40):
            rows.append((len(rows), *(b ^ (rng.getrandbits(60) if k == family else sum(1 << v for v in rng.sample(range(60), 2))) for k, b in enumerate(base))))
    hashes = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} long" for n in dedup.THRESHOLDS))
    monkeypatch.setattr(dedup, "SIDE", side)
    pairs, links = dedup.near_pairs(hashes, queries.RULE).cache(), dedup.near_links(hashes, queries.RULE).cache()
    groups = [sorted(map(tuple, dedup.components(x).collect())) for x in (pairs, links)]
    found = [{r.group_id: tuple(r.hit_evidence) for r in dedup.evidence(x, dedup.components(x), queries.RULE).collect()} for x in (pairs, links)]
    assert groups[0] == groups[1] and len(groups[0]) == 160 and found[0] == found[1] and set(map(len, found[0].values())) == {3}
    assert pairs.count() > 2_000 and links.select("a", "b").distinct().count() < pairs.count() / 2


@pytest.mark.parametrize(("at_once", "small"), [(7, 0), (7, 50), (1 << 16, 1 << 12)])
def test_blocks_of_any_size_meet_the_same_rows(monkeypatch, at_once, small):
    monkeypatch.setattr(dedup, "AT_ONCE", at_once)
    monkeypatch.setattr(dedup, "SMALL", small)
    rng = np.random.default_rng(5)
    value, key = rng.integers(0, 16, 80, dtype=np.uint64), rng.integers(0, 9, 80, dtype=np.uint64)
    near = lambda x, y: key[x] == key[y] and int(value[x] ^ value[y]).bit_count() <= 1
    pairs = lambda left, right: [(int(x), int(y)) for xs, ys in dedup._met(value, key, left, right, 1) for x, y in zip(xs, ys, strict=True)]
    assert sorted(map(tuple, map(sorted, pairs(np.arange(80), None)))) == [(x, y) for x in range(80) for y in range(x + 1, 80) if near(x, y)]
    assert sorted(pairs(np.arange(30), np.arange(30, 80))) == [(x, y) for x in range(30) for y in range(30, 80) if near(x, y)]
    assert not pairs(np.arange(0), np.arange(80)) and not pairs(np.arange(0), None)


def test_groups_read_their_hashes_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    schema = "id long, " + ", ".join(f"{n} long" for n in dedup.THRESHOLDS)
    hashes = spark.createDataFrame([(i, *[i % 3] * 4) for i in range(12)], schema).mapInPandas(counted, schema)
    assert dedup.perceptual_groups(hashes).count() == 12 and read.value == 12


def test_slices_with_equal_rows_are_taken_once(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None), ("d", 3.0)], "image_path string, v double")
    some = [slices.Slice("x", "c", "v", limit=2), slices.Slice("y", "c", "v", limit=2), slices.Slice("z", "c", "v", False, "v < 3")]
    got = sorted(map(tuple, slices.take_all(rows, some).collect()))
    assert got == [("x", 1, "b"), ("x", 2, "d"), ("y", 1, "b"), ("y", 2, "d"), ("z", 1, "a")]


def test_labels_are_compared_on_unrounded_measures(spark):
    hue, flat = [0.0] * 11 + [0.1] * 6 + [0.4] + [0.0] * 6, [1 / 16] * 16
    row = spark.createDataFrame([("a", flat, flat, hue, True, 0.0, 0.0, 0.0)], "id string, brightness_hist array<double>, saturation_hist array<double>, hue_hist array<double>, hue_valid boolean, brightness_hist_outlier double, saturation_hist_outlier double, hue_hist_outlier double")
    ratio = histogram.summary(row, digits=None).first()["hue_cool_ratio"]
    at, below = LabelConfig(cool_ratio=ratio), LabelConfig(cool_ratio=float(np.nextafter(ratio, 0)))
    measured = histogram.summary(row, below, digits=None)
    assert "cool" in measured.first()["labels"].split(";")
    assert calibrate.compare(measured, below, at, "id").first()["removed_labels"] == "cool"
    assert {r["label"]: r["added"] for r in calibrate.compare_counts(measured, at, below).collect()}["cool"] == 1


def test_registered_comparisons_use_unrounded_measures(spark):
    measured = queries._measured(spark, "/root/testdata/sf0.001")
    assert measured.where("hue_cool_ratio != round(hue_cool_ratio, 6)").count()


def test_hashes_shuffle_no_words(spark, tmp_path):
    rows = [(1, "a b c"), (1, "a d"), (1, " "), (2, "x"), (3, "  "), (4, None), (5, "P q r q\tr p q")]
    at = str(tmp_path / "tables")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")

    def majority(grams, k):
        bits = [int(hashlib.md5(g.encode()).hexdigest()[k : k + 15], 16) for g in grams]
        return sum(1 << b for b in range(60) if 2 * sum(v >> b & 1 for v in bits) > len(bits)) if bits else None

    words = {1: (["a", "b", "c", "a", "d"], ["a b", "b c", "a d"]), 2: (["x"], []), 5: (["p", "q", "r"], ["p q", "q r", "r q", "r p"])}
    want = {i: tuple(majority(g, k) for g in (w, p) for k in (0, 16)) for i, (w, p) in words.items()}
    assert {r[0]: tuple(r[1:]) for r in views.hashes(spark, at).collect()} == want
    spark.createDataFrame(rows[2:], "doc_id long, text string").write.parquet(f"{at}2/documents.parquet")
    assert "Exchange" not in views.hashes(spark, f"{at}2")._jdf.queryExecution().toString()


def test_a_text_of_one_word_leaves_the_hashes_of_others(spark, tmp_path):
    """A hash of 60 bits beside a missing one stays whole, in either order and where all or none are missing."""
    rows = [(1, "a b c"), (2, "x"), (3, "d e f g")]
    found = []
    for k, some in enumerate([rows, rows[::-1], rows[:1], rows[1:2], rows[2:], []]):
        at = str(tmp_path / f"t{k}")
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
        found.append({r[0]: tuple(r[1:]) for r in views.hashes(spark, at).collect()})
    assert found[0] == found[1] == found[2] | found[3] | found[4] and found[5] == {}
    assert found[0][2][2:] == (None, None)
    bits = [int(hashlib.md5(g).hexdigest()[:15], 16) for g in (b"a b", b"b c")]
    assert found[0][1][2] == bits[0] & bits[1]


@pytest.mark.parametrize(("piece", "at_once", "unpacked"), [(40, 3, 2), (1 << 20, 1 << 13, 300)])
def test_digests_of_many_texts_are_those_of_each(monkeypatch, piece, at_once, unpacked):
    """Texts of one row or several, blank ones, grams about the length of one block and beyond, more than 255 grams, in pieces of any size."""
    for n, v in (("PIECE", piece), ("AT_ONCE", at_once), ("UNPACKED", unpacked)):
        monkeypatch.setattr(grams, n, v)
    texts = ["", " \n ", "a", "a a", "É b\tb\r\nc  É b", "x" * 55, "x" * 56 + " " + "y" * 64, "p" * 27 + " " + "q" * 27, "p" * 27 + " " + "q" * 28, " ".join(str(i * i % 997) for i in range(1500))]
    row = np.array([0, 1, 2, 2, 3, 4, 5, 6, 7, 8])
    words, pairs = grams.Majorities(10), grams.Majorities(10)
    grams.count([t.encode() for t in texts], row, words, pairs)
    got = {of: (of.n, *of.hashes(60)) for of in (words, pairs)}
    for r in range(10):
        split = [t.split() for t, at in zip(texts, row, strict=True) if at == r]
        for of, of_text in ((words, lambda w: set(w)), (pairs, lambda w: {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})):
            found = [hashlib.md5(g.encode()).hexdigest() for w in split for g in of_text(w)]
            most = [sum(1 << b for b in range(60) if 2 * sum(int(d[k : k + 15], 16) >> b & 1 for d in found) > len(found)) for k in (0, 16)]
            assert [v[r] for v in got[of]] == [len(found), *most]


def test_groups_of_near_duplicates_are_not_sent_by_the_driver(spark, monkeypatch):
    plans, at = [], graph.cut

    def noted(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return at(df)

    monkeypatch.setattr(graph, "cut", noted)
    monkeypatch.setattr(dedup, "cut", noted)
    monkeypatch.setattr(dedup, "written", lambda df, _: noted(df))
    rows = [(1, 0, 0, 0, 0), (2, 1, 0, 0, 0), (3, 7, 1, 0, 0), (4, -1, -1, -1, 0), (5, -1, -1, -1, 0)]
    hashes = spark.createDataFrame(rows, "id long, phash long, dhash long, whash long, colorhash long")
    assert sorted(map(tuple, noted(dedup.perceptual_groups(hashes)).collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2)]
    pairs = noted(dedup.near_pairs(dedup.hash_classes(hashes, dedup.PairRule())))
    assert noted(dedup.evidence(pairs, dedup.components(pairs))).first()["hit_evidence"] == ["colorhash", "dhash", "phash", "whash"]
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]
