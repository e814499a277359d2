import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import vectors as V
from gridlore.operators import similarity as S

H = 1 / math.sqrt(2)
CUBE = {(0, 0): [1, 0, 0, 0], (0, 1): [0, 1, 0, 0], (0, 2): [1, 0, 0, 0], (1, 0): [0, 0, 1, 0], (1, 1): [H, H, 0, 0], (1, 2): [-1, 0, 0, 0]}
E1, E2 = [1.0, 0, 0, 0], [0, 1.0, 0, 0]


@pytest.fixture
def cube(spark):
    return spark.createDataFrame([("g", r, c, [float(x) for x in v]) for (r, c), v in CUBE.items()], "grid_id string, row int, col int, embedding array<float>")


def grid(df, column="similarity"):
    return {(r["row"], r["col"]): r[column] for r in df.collect()}


def vectors(spark, *rows):
    return spark.createDataFrame([(0, i, [float(x) for x in r]) for i, r in enumerate(rows)], "row int, col int, embedding array<float>")


def test_normalise(spark):
    got = [r[0] for r in vectors(spark, [3, 4], [0, 0]).select(V.normalise("embedding")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0, 0]


def test_mean_and_medoid(spark):
    seeds = vectors(spark, E1, E2)
    assert S.aggregate_seeds(seeds) == pytest.approx([H, H, 0, 0])
    assert S.aggregate_seeds(seeds, " MEDOID ") == E1
    with pytest.raises(ValueError):
        S.aggregate_seeds(seeds, "median")
    with pytest.raises(ValueError):
        S.aggregate_seeds(seeds.limit(0))


def test_medoid_equals_pairwise_argmax(spark):
    x = np.random.default_rng(5).normal(size=(60, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = u[(u @ u.T).sum(axis=1).argmax()]
    assert S.aggregate_seeds(vectors(spark, *x), "medoid") == pytest.approx(best, abs=1e-6)


def test_maps(cube):
    assert grid(S.similarity_map(cube, E1)) == pytest.approx({(0, 0): 1, (0, 1): 0.5, (0, 2): 1, (1, 0): 0.5, (1, 1): (H + 1) / 2, (1, 2): 0}, abs=1e-6)
    raw = grid(S.similarity_map(cube, E1, rescale=False))
    assert raw[0, 0] == pytest.approx(1) and raw[1, 2] == pytest.approx(-1)
    assert grid(S.similarity_map(cube, [E1, E2], rescale=False))[0, 1] == pytest.approx(1)
    assert grid(S.similarity_map_vectorised(cube, [E1, E2], rescale=False)) == pytest.approx(grid(S.similarity_map(cube, [E1, E2], rescale=False)), abs=1e-6)


def test_invalid_pixels_are_null(spark, cube):
    holed = cube.withColumn("embedding", F.when((F.col("row") == 1) & (F.col("col") == 2), F.array(*[F.lit(float("nan")).cast("float")] * 4)).otherwise(F.col("embedding")))
    got = grid(S.similarity_map(holed, E1))
    assert [k for k, v in got.items() if v is None] == [(1, 2)]
    assert [k for k, v in grid(S.similarity_map_vectorised(holed, [E1])).items() if v is None] == [(1, 2)]


def test_bands_must_agree(cube):
    with pytest.raises(Exception, match="bands"):
        S.similarity_map(cube, [1.0, 0, 0]).collect()


def test_threshold_mask(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, float("nan")), (3, 0.95), (4, None)], "i int, similarity float")
    assert [r["mask"] for r in S.threshold_mask(df, 0.9).orderBy("i").collect()] == [1, 0, 0, 1, 0]
    near = spark.createDataFrame([(0.7,)], "similarity float")
    assert S.threshold_mask(near, 0.7).first()["mask"] == 1


def test_search_and_top_k(spark, cube):
    seeds = spark.createDataFrame([("g", 0, 0), ("g", 0, 2), ("g", 0, 0)], "grid_id string, row int, col int")
    out = S.search(cube, seeds, threshold=0.9)
    assert sorted(k for k, v in grid(out, "mask").items() if v) == [(0, 0), (0, 2)]
    with pytest.raises(ValueError):
        S.search(cube, seeds, threshold=2)
    assert [(r["row"], r["col"]) for r in S.top_k(cube, E1, 2, ["row", "col"]).collect()] == [(0, 0), (0, 2)]


def test_single_reference_needs_no_join(cube):
    plan = S.similarity_map(cube, E1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_valid_rule(spark):
    rows = vectors(spark, [1, 2], [float("nan"), 3], [-128, -128], [float("inf"), 1], [-128, 1])
    assert [r[0] for r in rows.orderBy("col").select(V.valid("embedding", -128.0)).collect()] == [True, False, False, False, True]
    assert [r[0] for r in rows.orderBy("col").select(V.valid("embedding")).collect()] == [True, False, True, False, True]


def test_quantise_round_trip(spark):
    x = [-1.0, -0.5, 0.0, 0.3, 1.0, float("nan")]
    q = vectors(spark, x).select(V.quantise("embedding").alias("q"))
    assert q.first()["q"] == [-127, -64, 0, 38, 127, -128]
    back = q.select(V.dequantise("q")).first()[0]
    assert back[:5] == pytest.approx(x[:5], abs=0.5 / 127.5 + 1e-6) and back[5] == -9999.0
