import numpy as np
import pytest

from gridlore.functions import geometry as G
from gridlore.operators import sampling as P

GRID = G.Grid("g", "EPSG:3577", 2, 2, 0.0, 10.0, 0.0, 100.0, 0.0, -10.0, -9999.0, 2)


@pytest.fixture
def pixels(spark):
    return spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0, 6.0]), (1, 1, [-9999.0, -9999.0])], "row int, col int, embedding array<float>")


def features(spark, *rows):
    return spark.createDataFrame(rows, f"feature_id long, geom_type string, rings {P.RINGS}, class string")


def test_index_cuts_towards_zero(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(5.0, 95.0), (25.0, 75.0), (-5.0, 105.0)], "x double, y double")
    got = df.select(G.row_of(F.col("y"), F.lit(100.0), F.lit(-10.0)), G.column_of(F.col("x"), F.lit(0.0), F.lit(10.0))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (2, 2), (0, 0)]


def test_gather_keeps_order_and_checks(spark, pixels):
    places = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "ordinal int, row int, col int")
    assert [r["embedding"] for r in P.gather(pixels, places, GRID).collect()] == [[5, 6], [1, 2]]
    assert P.gather(pixels, places.limit(0), GRID).count() == 0
    with pytest.raises(Exception, match="outside"):
        P.gather(pixels, spark.createDataFrame([(0, 5, 0)], "ordinal int, row int, col int"), GRID).collect()


def test_feature_pixels(spark):
    f = features(
        spark,
        (1, "point", [[(5.0, 95.0), (6.0, 94.0), (15.0, 95.0)]], "a"),
        (2, "polygon", [[(0.0, 80.0), (20.0, 80.0), (20.0, 100.0), (0.0, 100.0)]], "b"),
        (3, "polygon", [[(11.0, 88.0), (13.0, 88.0), (13.0, 89.0), (11.0, 89.0)]], "c"),
        (4, "line", [[(1.0, 99.0), (9.0, 91.0)]], "d"),
        (5, "point", [[(500.0, 500.0)]], "e"),
        (6, "point", None, "f"),
    )
    got = {}
    for r in P.feature_pixels(f, GRID).collect():
        got.setdefault(r["feature_id"], set()).add((r["row"], r["col"]))
    assert got == {1: {(0, 0), (0, 1)}, 2: {(0, 0), (0, 1), (1, 0), (1, 1)}, 3: {(1, 1)}, 4: {(0, 0)}}
    assert P.feature_pixels(f, GRID, across=True).count() == 4


def test_too_many_cells(spark):
    big = G.Grid("g", "EPSG:3577", 3000, 3000, 0.0, 1.0, 0.0, 3000.0, 0.0, -1.0)
    f = features(spark, (1, "polygon", [[(0.0, 0.0), (3000.0, 0.0), (3000.0, 3000.0), (0.0, 3000.0)]], "a"))
    with pytest.raises(Exception, match="cells"):
        P.feature_pixels(f, big).count()


def test_extract_and_training(spark, pixels):
    f = features(spark, (1, "point", [[(5.0, 95.0)]], "a"), (2, "point", [[(15.0, 85.0)]], "b"))
    rows = P.extract(pixels, f, GRID).collect()
    assert len(rows) == 1 and rows[0]["A01"] == 2.0 and rows[0]["pixel_x"] == 5.0 and rows[0]["class"] == "a"
    assert P.extract(pixels, f, GRID, skip_nodata=False).count() == 2
    train, used = P.training_rows(pixels, f, GRID, "class")
    assert used == 1 and [r["label"] for r in train.collect()] == ["a"]
    assert P.unique_names(["A00", "x"], ["a00", "A00_2"]) == ["A00_3", "x"]


def test_reproject_utm_and_albers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(153.0, -27.5), (147.0, -35.0)], "lon double, lat double")
    e, n = G.project(F.col("lon"), F.col("lat"), "EPSG:32756")
    row = df.select(e, n).first()
    # on the central meridian the northing is the scaled length of the meridian, by quadrature
    phi = np.radians(np.linspace(0, 27.5, 200_001))
    e2 = 2 / 298.257223563 - 1 / 298.257223563**2
    arc = np.trapezoid(6378137.0 * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert row[0] == pytest.approx(500000, abs=1e-6) and row[1] == pytest.approx(1e7 - 0.9996 * arc, abs=1e-3)
    x, y = G.project(F.col("lon"), F.col("lat"), "EPSG:3577")
    rows = df.select(x, y).collect()
    assert 2.0e6 < rows[0][0] < 2.2e6 and -3.2e6 < rows[0][1] < -2.9e6
    with pytest.raises(ValueError):
        G.project(F.col("lon"), F.col("lat"), "EPSG:3857")


def test_grid_planning():
    assert G.plan_grid((0, 0, 100, 100), 10) == (10, 10, (0, 0, 100, 100))
    assert G.plan_grid((0, 0, 95, 95), 10) == (10, 10, (0, -5, 100, 95))
    for bad in (((0, 0, 0, 1), 1), ((0, 0, 1, 1), 0), ((0, 0, float("nan"), 1), 1)):
        with pytest.raises(ValueError):
            G.plan_grid(*bad)
    assert G.is_large(40000, 40000) and not G.is_large(10, 10)
    assert G.years_from_indices([8, 0, 0]) == [2017, 2025]
    with pytest.raises(ValueError):
        G.years_from_indices([9])
    assert GRID.pixel_area() == 100 and not GRID.aligned_with(G.grid_for("h", (0, 0, 20, 10), 10))
