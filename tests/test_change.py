import math

import pytest

from gridlore.operators import change as C

H = 1 / math.sqrt(2)


def cubes(spark, *years):
    rows = [("g", 2017 + y, 0, c, [float(x) for x in v]) for y, layer in enumerate(years) for c, v in enumerate(layer)]
    return spark.createDataFrame(rows, "grid_id string, year int, row int, col int, embedding array<float>")


def values(df):
    return [r["value"] for r in df.orderBy("col").collect()]


@pytest.mark.parametrize("metric,want", [("cosine", [0, 1, 2]), (" Euclidean ", [0, math.sqrt(2), 2])])
def test_pairwise(spark, metric, want):
    df = cubes(spark, [[1, 0]] * 3, [[1, 0], [0, 1], [-1, 0]])
    assert values(C.change(df, metric)) == pytest.approx(want, abs=1e-6)


def test_unit_vectors_tie_the_metrics(spark):
    df = cubes(spark, [[1, 0], [H, H]], [[H, H], [0, -1]])
    assert values(C.change(df, "euclidean")) == pytest.approx([math.sqrt(2 * v) for v in values(C.change(df))], abs=1e-5)


def test_trajectory_pairs_and_anomaly(spark):
    df = cubes(spark, [[1, 0]], [[0, 1]], [[1, 0]])
    assert values(C.change(df, mode="trajectory")) == pytest.approx([2])
    assert values(C.change(df, "euclidean", "trajectory")) == pytest.approx([2 * math.sqrt(2)])
    steps = C.consecutive(df).orderBy("year_from").collect()
    assert [s["value"] for s in steps] == pytest.approx([1, 1])
    two = cubes(spark, [[1, 0]], [[0, 1]])
    assert values(C.change(two, mode="anomaly")) == pytest.approx([1 - H], abs=1e-6)
    assert values(C.change(two, "euclidean", "anomaly")) == pytest.approx([math.sqrt(0.5)])


def test_pairwise_passes_over_middle_years_but_not_their_holes(spark):
    df = cubes(spark, [[1, 0], [1, 0]], [[0, 1], [float("nan"), 0]], [[1, 0], [1, 0]])
    assert values(C.change(df)) == [pytest.approx(0), None]


def test_a_missing_year_is_no_value(spark):
    df = cubes(spark, [[1, 0], [1, 0]], [[0, 1], [0, 1]]).filter("NOT (year = 2018 AND col = 1)")
    assert values(C.change(df)) == [pytest.approx(1), None]


def test_errors(spark):
    df = cubes(spark, [[1, 0]], [[0, 1]])
    for call in (lambda: C.change(df, "manhattan"), lambda: C.change(df, mode="wild"), lambda: C.change(df.filter("year = 2017"))):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="bands"):
        C.change(cubes(spark, [[1, 0]], [[0, 1, 2]])).collect()
    with pytest.raises(ValueError):
        C.require_any(C.change(cubes(spark, [[float("nan"), 0]], [[0, 1]])))


def test_one_shuffle(spark):
    df = cubes(spark, [[1, 0]], [[0, 1]], [[1, 0]])
    for mode in C.MODES:
        plan = C.change(df, mode=mode, years=[2017, 2018, 2019])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
