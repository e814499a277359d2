import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import presets, report as R, rgb

X = [[0, 0.1, 0.2, None], [0.3, 0.4, 0.5, 0.6], [0.7, 0.8, 0.9, 1], [float("nan"), 0.05, 0.15, 0.25]]


@pytest.fixture
def values(spark):
    return spark.createDataFrame([("g", r, c, None if v is None else float(v)) for r, row in enumerate(X) for c, v in enumerate(row)], "grid_id string, row int, col int, value float")


def test_summary_and_histogram(spark, values):
    assert R.finite_values(values).count() == 14
    five = R.summarise(spark.createDataFrame([(float(i),) for i in range(5)], "value double")).first()
    assert (five["n"], five["min"], five["max"], five["mean"], five["median"], five["p50"], five["std"]) == (5, 0, 4, 2, 2, 2, pytest.approx(np.sqrt(2)))
    bins = R.histogram(values, 5).orderBy("bin").collect()
    finite = [v for row in X for v in row if v is not None and v == v]
    assert [b["n"] for b in bins] == np.histogram(np.array(finite, np.float32), 5)[0].tolist()
    one = R.histogram(spark.createDataFrame([(3.0,)] * 4, "value double"), 2).orderBy("bin").collect()
    assert (one[0]["low"], one[1]["high"]) == (2.5, 3.5) and sum(b["n"] for b in one) == 4
    with pytest.raises(ValueError):
        R.histogram(values, 0)
    with pytest.raises(ValueError):
        R.histogram(values.filter("value > 5"))


def test_areas_series_scatter(spark, values):
    rows = R.area_fractions(values, (0.9, 0, 0.5)).orderBy("threshold").collect()
    assert [r["threshold"] for r in rows] == [0, 0.5, 0.9] and rows[0]["fraction"] == 1 and rows[0]["hectares"] is None
    assert R.area_fractions(values, (0,), 100).first()["hectares"] == pytest.approx(0.14)
    s = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", float("nan")), ("c", 1.0), ("c", 2.0), ("c", 3.0)], "period string, value double")
    got = {r["period"]: (r["mean"], r["n"]) for r in R.series_points(s).collect()}
    assert got == {"a": (pytest.approx(0.2), 2), "c": (2, 3)}
    make = lambda name, v: spark.createDataFrame([("g", 0, i, x) for i, x in enumerate(v)], f"grid_id string, row int, col int, {name} double")
    nan = float("nan")
    pairs = R.scatter_sample(make("x", [1.0, 2.0, nan, 4.0]), make("y", [0.1, nan, 0.3, 0.4])).collect()
    assert [(p["x"], p["y"]) for p in pairs] == [(1, 0.1), (4, 0.4)]
    many = make("x", [float(i) for i in range(500)]), make("y", [float(i) for i in range(500)])
    a, b = (R.scatter_sample(*many, n=100).collect() for _ in range(2))
    assert len(a) == 100 and a == b


def test_model_and_rendering(spark, values, tmp_path):
    with pytest.raises(ValueError):
        R.build(values.filter("value > 5"))
    only = R.build(values, R.Request(("series", "scatter")))
    assert only.stats is None and len(only.notes) == 2
    s = spark.createDataFrame([("a,b", 1.0)], "period string, value double")
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    full = R.build(values, R.Request(thresholds=(0.5,)), "<Title>", 100, s, points)
    text = R.to_csv(full)
    assert sum(line.startswith("# ") for line in text.splitlines()) == 7 and '"a,b"' in text
    page = R.to_html(full)
    assert "&lt;Title&gt;" in page and "<Title>" not in page and page.count("<svg") == 3 and "http" not in page
    done, warnings = R.write_all(full, {"csv": str(tmp_path / "r.csv"), "html": str(tmp_path / "no" / "r.html"), "png": str(tmp_path / "r.png")})
    assert "csv" in done and "html" not in done and len(warnings) >= 1
    assert R.parse_thresholds("0.2; x,0.4") == (0.2, 0.4) and R.parse_thresholds("") == R.THRESHOLDS
    assert R.Request.parse([9], 0, None, 0) == R.Request()
    assert R.pair_labels([2017, 2018, None]) == ["2017 -> 2018", "period 2"]


def pixels(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, embedding array<float>")


def test_components(spark):
    x = np.random.default_rng(1).normal(size=(25, 6)) * [9, 1, 1, 1, 1, 1]
    fitted = rgb.fit_components(pixels(spark, x))
    axes = np.array(fitted.axes)
    assert axes.shape == (3, 6) and np.linalg.norm(axes, axis=1) == pytest.approx([1, 1, 1])
    u, _, vt = np.linalg.svd(x.astype(np.float32) - x.astype(np.float32).mean(axis=0))
    assert np.abs((axes * vt[:3]).sum(axis=1)) == pytest.approx([1, 1, 1], abs=1e-4)
    assert np.abs(axes[0]).argmax() == 0 and axes[0, 0] > 0
    got = np.array([[r["c1"], r["c2"], r["c3"]] for r in rgb.project(pixels(spark, x), fitted).collect()])
    assert got.mean(axis=0) == pytest.approx([0, 0, 0], abs=1e-5)
    assert len(rgb.fit_components(pixels(spark, x[:2])).axes) == 2


def test_bytes_and_render(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.5, 1, 2)], "v double")
    assert [r[0] for r in df.select(rgb.to_byte("v", 0, 1)).collect()] == [0, 0, 128, 255, 255]
    assert df.select(rgb.to_byte(F.lit(3.0), 3, 3)).first()[0] == 0
    hundred = spark.createDataFrame([(float(i),) for i in range(101)], "c1 double")
    assert rgb.stretch_bounds(hundred, 2, 98, ("c1",)) == [(2, 98)]
    x = np.vstack([np.random.default_rng(2).normal(size=(20, 4)), [[-9999.0] * 4]])
    out = rgb.render(pixels(spark, x), "bands", (0, 1, 2), nodata=-9999.0).orderBy("i").collect()
    assert (out[-1]["red"], out[-1]["green"], out[-1]["blue"]) == (0, 0, 0) and max(r["red"] for r in out) == 255
    for bad in (lambda: rgb.render(pixels(spark, x), "wild"), lambda: rgb.render(pixels(spark, x[-1:]), nodata=-9999.0), lambda: rgb.stretch_bounds(hundred, 50, 50, ("c1",)), lambda: rgb.parse_bands("1,2")):
        with pytest.raises(ValueError):
            bad()
    assert rgb.parse_bands("1;22,43") == (0, 21, 42)


def test_presets():
    for family in presets.FAMILIES.values():
        keys = [p.key for p in family]
        assert len(keys) == len(set(keys)) and len(presets.labels(family)) == len(keys)
    assert presets.by_key(presets.RGB, " PCA ").key == "pca" and presets.by_index(presets.CHANGE, 2).as_dict()["mode"] == "anomaly"
    with pytest.raises(KeyError):
        presets.by_key(presets.RGB, "x")
    with pytest.raises(IndexError):
        presets.by_index(presets.RGB, 4)


def test_quantiles_of_large_tables_equal_those_of_small(spark):
    from gridlore.functions.quantiles import quantiles

    x = np.concatenate((np.random.default_rng(8).exponential(size=4000), [0.5] * 3000, [1e9]))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    shares = [0, 0.02, 0.05, 0.5, 0.501, 0.98, 1]
    want = np.quantile(x, shares)
    assert quantiles(df, "x", shares) == pytest.approx(want)
    assert quantiles(df, "x", shares, small=10, few=50) == pytest.approx(want)
    assert quantiles(df.limit(0), "x", [0.5]) == [None]
