"""Carts against a plain loop over their events; ranks within groups; the channel registry."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import cart, channels, export, slices

SCHEMA = "cart_id long, item string, seq long, kind string, value double"


def by_loop(rows):
    out = []
    for c in sorted({r[0] for r in rows if r[0] is not None}):
        held, top = {}, None
        for _, item, seq, kind, value in sorted({r for r in rows if r[0] == c and r[2] is not None}, key=lambda r: r[2]):
            if kind == "clear":
                held = {}
            elif kind == "top_n":
                top = value if value is not None else top
            elif item is None:
                continue
            elif kind == "add":
                held.setdefault(item, float(seq))
            elif kind == "remove":
                held.pop(item, None)
            elif kind == "toggle":
                if item in held:
                    del held[item]
                else:
                    held[item] = float(seq)
            elif kind == "reorder" and item in held and value is not None:
                held[item] = value
        ordered = sorted(held, key=lambda i: (held[i], i))
        out += [(c, i, k) for k, i in enumerate(ordered if top is None else ordered[: max(int(top), 0)], 1)]
    return out


def events(n, carts, items, seed, kinds=("add", "add", "toggle", "toggle", "remove", "reorder", "noise")):
    rng = random.Random(seed)
    return [(rng.randrange(carts), f"i{rng.randrange(items)}", k, rng.choice(kinds), rng.choice([None, -5.0, float(rng.randrange(n)), 0.5])) for k in range(n)]


@pytest.mark.parametrize("parts", [None, 7])
def test_carts_against_a_loop(spark, parts):
    rows = events(900, 6, 15, 1)
    rows += [(c, i, 1000 + s, k, v) for c, i, s, k, v in events(200, 6, 15, 3, ("add", "toggle", "clear", "reorder", "remove", "add", "add", "add"))]
    rows += [(1, None, 2001, "top_n", 3.0), (2, None, 2002, "top_n", 5.0), (2, None, 2003, "top_n", None), (3, None, 2004, "top_n", 0.0)]
    got = cart.cart_state(spark.createDataFrame(rows, SCHEMA).repartition(5), parts)
    assert sorted(map(tuple, got.collect())) == sorted(by_loop(rows))


def test_one_long_cart_is_folded_in_parts(spark):
    rows = events(3000, 1, 3, 4)  # items that come and go thousands of times
    got = cart.cart_state(spark.createDataFrame(rows, SCHEMA), parts=9)
    assert sorted(map(tuple, got.collect())) == sorted(by_loop(rows))


def test_functions_compose_as_events_do():
    rng = random.Random(5)
    for _ in range(500):
        run = [(rng.choice(cart.ITEM_KINDS), float(k), rng.choice([None, -1.0, 9.5])) for k in range(rng.randrange(8))]
        k = rng.randrange(len(run) + 1)
        fold = lambda part: functools.reduce(cart._then, (cart._event(*e) for e in part), cart.IDENTITY)
        assert cart._then(fold(run[:k]), fold(run[k:])) == fold(run)


def test_odd_events(spark):
    rows = [(None, "a", 1, "add", None), (1, "a", None, "add", None), (1, None, 2, "add", None), (1, "b", 3, "add", None), (1, "b", 3, "add", None), (1, "c", 4, None, None), (2, "x", 1, "toggle", None), (2, "x", 1, "toggle", None), (3, "y", 1, "remove", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("place", "position", "_top", "first_seq")})
    assert sorted(map(tuple, cart.cart_state(df).collect())) == [(1, "b", 1), (2, "x", 1)]
    assert cart.cart_state(df.limit(0)).collect() == []


def test_ranks_within_groups_of_any_size(spark):
    rows = [(None if k % 97 == 0 else "hot" if k % 2 else f"g{k % 11}", (k * 7919) % 4001, k) for k in range(4000)]
    got = slices.ranked_within(spark.createDataFrame(rows, "g string, v long, k long").repartition(6), ["g"], "v", "k").collect()
    held = {}
    for g, v, k in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        held.setdefault(g, []).append(k)
    assert {(r["g"], r["k"]): r["rank"] for r in got} == {(g, k): n for g, ks in held.items() for n, k in enumerate(ks, 1)}


def test_by_cluster_has_no_task_with_a_whole_cluster(spark):
    """Half of the rows are one cluster and one file name, yet all parts of the numbering are about as large."""
    rows = spark.range(4000).select(
        F.col("id").alias("image_id"), F.concat(F.lit("d"), "id", F.lit("/"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")), F.lit(".jpg")).alias("path"),
        F.when(F.col("id") % 2 == 0, 7).otherwise((F.col("id") % 50).cast("int")).alias("cluster_id"), F.lit("n").alias("cluster_name"), F.col("id").alias("position"),
    )
    plan = export.by_cluster(rows)
    assert plan.select("target").distinct().count() == 4000
    sizes = [r["n"] for r in slices.ranked(rows, "cluster_id", "position").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


# ---- channel registry -------------------------------------------------------------------------------------------


@pytest.fixture
def registry(spark):
    table = spark.createDataFrame([(f"p{k}", k, k / 7, "warm;low_key" if k % 3 == 0 else "cool", k * 1.5) for k in range(30)], "image_path string, width int, ratio double, labels string, secret double")
    reg = channels.Registry([channels.Channel("histogram", lambda t: t["in"], labels=("warm", "cool", "low_key"), debug=("secret",)), channels.Channel("plugins")])
    return reg, {"in": table}


def test_registry_builds_describes_and_extends(spark, registry):
    reg, inputs = registry
    reg.extend("histogram", "twice", F.col("width") * 2)
    reg.extend("histogram", "hidden", F.col("ratio") + 1, debug=True)
    table = reg.build("histogram", inputs)
    rows = {r["channel"]: r for r in reg.describe(spark, {"histogram": table}).collect()}
    h = rows["histogram"]
    assert (h["built"], h["sort_fields"], h["filter_fields"], h["debug_only_fields"]) == (True, ["ratio", "twice", "width"], ["cool", "low_key", "warm"], ["hidden", "secret"])
    assert rows["plugins"]["built"] is False and rows["plugins"]["buildable"] is False and rows["plugins"]["field_count"] == 0
    for wrong in (lambda: reg.build("none", inputs), lambda: reg.build("plugins", inputs), lambda: reg.extend("histogram", "twice", F.lit(1))):
        with pytest.raises(channels.Refused):
            wrong()
    reg.extend("histogram", "width", F.lit(1))
    with pytest.raises(channels.Refused):
        reg.build("histogram", inputs)


def test_registry_answers_only_what_a_channel_can(spark, registry):
    reg, inputs = registry
    table = reg.build("histogram", inputs)
    rows, total = reg.page("histogram", table, "ratio", label="warm", where="width > 3 AND labels LIKE '%low%'", limit=4)
    assert total == 8 and [r["width"] for r in rows.collect()] == [27, 24, 21, 18]
    assert reg.page("histogram", table, "secret", debug=True)[1] == 30
    bad = (dict(sort_by="secret"), dict(sort_by="none"), dict(sort_by="ratio", label="blurry"), dict(sort_by="ratio", where="secret > 1"), dict(sort_by="ratio", where="1 = "), dict(sort_by="ratio", where="width > (SELECT 1)"), dict(sort_by="ratio", where="EXISTS (SELECT 1)"), dict(sort_by="ratio", where="none > 1"))
    for request in bad:
        with pytest.raises(channels.Refused):
            reg.page("histogram", table, **request)


def test_parts_of_an_item_compose_in_one_aggregate(spark):
    rng = random.Random(8)
    one = lambda k: rng.choice([("add", k, None), ("remove", k, None), ("toggle", k, None), ("reorder", k, None), ("reorder", k, -2.5)])
    rows, want = [], {}
    for item in range(300):
        f = cart.IDENTITY
        for k in range(rng.randrange(1, 7)):
            g = cart._event(*one(float(k)))
            f = cart._then(f, g)
            rows.append((item, k, *g))
        want[item] = f[0]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"item int, first_seq long, {cart.FUNCTION}")
    found = df.groupBy("item").agg(cart._composed(F.collect_list(F.struct("first_seq", "from_absent", "stays", "moved"))).alias("place"))
    assert {r["item"]: r["place"] for r in found.collect()} == want
    assert "InPandas" not in found._jdf.queryExecution().toString()
