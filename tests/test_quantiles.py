"""Exact quantiles against NumPy: ties, nulls, skew, and enclosures that must be narrowed several times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import quantiles

PROBS = (0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0)


def check(df, columns, most=None, monkeypatch=None):
    if most is not None:
        monkeypatch.setattr(quantiles, "MOST_FETCHED", most)
    got = quantiles.quantiles(df, dict.fromkeys(columns, PROBS))
    for name, values in columns.items():
        want = np.quantile(np.array(values, float), PROBS)
        assert got[name] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-300), name


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(5)
    n = 6000
    return {
        "normal": rng.normal(size=n).tolist(), "tied": rng.integers(0, 4, n).astype(float).tolist(), "mostly": np.where(rng.random(n) < 0.97, 1.0, rng.random(n) * 3).tolist(),
        "scales": (2.0 ** -np.arange(n).clip(0, 1000)).tolist(), "same": [7.0] * n, "ends": np.where(rng.random(n) < 0.5, -1e300, 1e300).tolist(),
    }


@pytest.fixture(scope="module")
def df(spark, columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5).cache()


@pytest.mark.parametrize("most", [quantiles.MOST_FETCHED, 40, 0])
def test_exact(df, columns, most, monkeypatch):
    check(df, columns, most, monkeypatch)


def test_a_sketch_that_misses_is_mended(df, columns, monkeypatch):
    # a sketch whose error is larger than the room that is left for it
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    check(df, {k: columns[k] for k in ("normal", "mostly")}, 10, monkeypatch)


def test_nulls_empty_columns_and_few_rows(spark):
    rows = [(1.0, None, 1), (None, None, 2), (3.0, None, None), (2.0, None, 9)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    got = quantiles.quantiles(df, {"a": [0.5, 0.25], "b": [0.5], "c": [0.0, 0.5, 1.0], })
    assert got == {"a": [2.0, 1.5], "b": [None], "c": [1.0, 2.0, 9.0]}
    assert quantiles.quantiles(df.limit(0), {"a": [0.1]}) == {"a": [None]}
    assert quantiles.quantiles(df.limit(1), {"a": [0.1, 0.1, 0.9]}) == {"a": [1.0, 1.0, 1.0]}
    assert quantiles.quantiles(df, {}) == {}


def test_plans_hold_no_percentile_over_rows():
    import inspect

    from tesserae.operators import quality, stats

    assert "F.percentile(" not in inspect.getsource(quality) + inspect.getsource(stats.column_stats) + inspect.getsource(stats.acceptance) + inspect.getsource(stats.robust_scale)
