import numpy as np
import pytest

from gridlore.operators import learning as M, models as B


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "g", i, 0, (rng.normal(size=3) * 0.1 + (5 if i % 2 else 0)).tolist(), "ab"[i % 2]) for i in range(40)]
    return spark.createDataFrame(rows, "sample_id long, grid_id string, row int, col int, embedding array<float>, label string")


def test_classify_report_save_and_reuse(spark, blobs, tmp_path):
    path = str(tmp_path / "model")
    fitted = M.fit_classifier(blobs, n_estimators=5, max_depth=4, accuracy_folds=2, save=path)
    assert fitted.accuracy["accuracy"] == 1 and "Cross-validated" in fitted.report and not fitted.warnings
    out = M.classify(blobs.drop("label"), fitted, confidence=True).collect()
    assert len(out) == 40 and all(0.5 <= r["confidence"] <= 1 for r in out)
    assert {(r["sample_id"] % 2, r["label"]) for r in out} == {(0, "a"), (1, "b")}
    again = M.fit_classifier(blobs, load=path)
    assert again.bundle.classes == ["a", "b"] and M.classify(blobs.drop("label"), again).filter("code IS NULL").count() == 0
    with pytest.raises(ValueError, match="regressor"):
        B.reuse_model(path, 3, "regressor")
    with pytest.raises(FileNotFoundError):
        B.load_model(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        M.fit_classifier(blobs.filter("label = 'a'"))


def test_tuning(blobs, monkeypatch):
    monkeypatch.setitem(B.TUNING, "rf", {"n_estimators": [3], "max_depth": [2, 3]})
    fitted = M.fit_classifier(blobs, tune=True, tune_iters=2)
    assert len(fitted.search["trials"]) == 2 and "Parameter search" in fitted.report


def test_boosted_classes_have_confidence(blobs):
    from pyspark.sql import functions as F

    three = blobs.withColumn("label", F.when(F.col("sample_id") < 10, "c").otherwise(F.col("label")))
    out = M.classify(three.drop("label"), M.fit_classifier(three, algorithm="gb", n_estimators=2), confidence=True)
    assert all(1 / 3 <= r["confidence"] <= 1 for r in out.collect())


def test_regress(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(60, 2))
    df = spark.createDataFrame([(i, "g", i, 0, v.tolist(), float(3 * v[0] - 2)) for i, v in enumerate(x)], "sample_id long, grid_id string, row int, col int, embedding array<float>, label double")
    fitted = M.fit_regressor(df, n_estimators=10, max_depth=6, accuracy_folds=3)
    assert fitted.accuracy["r2"] > 0.8 and fitted.accuracy["n"] == 60
    assert M.regress(df, fitted).filter("value IS NULL").count() == 0
    with pytest.raises(ValueError):
        M.fit_regressor(df.selectExpr("embedding", "'x' AS label"))


def test_cluster_and_silhouette(blobs):
    out, _ = M.cluster(blobs, 2, restarts=1)
    codes = {}
    for r in out.collect():
        codes.setdefault(r["label"], set()).add(r["code"])
    assert all(len(v) == 1 for v in codes.values()) and codes["a"] != codes["b"]
    k, scores = M.choose_k(blobs, 2, 4, restarts=1)
    assert k == 2 and len(scores) == 3
    rows = out.collect()
    x, c = np.array([r["embedding"] for r in rows]), np.array([r["code"] for r in rows])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = np.mean([(b - a) / max(a, b) for i in range(len(x)) for a, b in [(d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1), d[i][c != c[i]].mean())]])
    assert M.silhouette(out.select("embedding", "code"), block=7) == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        M.cluster(blobs.limit(2), 5)


def test_restarts_do_not_share_local_properties(spark, blobs, monkeypatch):
    from threading import Barrier
    from types import SimpleNamespace

    together, own, sc = Barrier(4), [], spark.sparkContext

    class Fit:
        summary = SimpleNamespace(trainingCost=0.0)

        def __init__(self, seed, **_):
            self.seed = str(seed)

        def fit(self, rows):
            sc.setLocalProperty("restart", self.seed)
            together.wait(30)
            own.append(sc.getLocalProperty("restart") == self.seed)
            return self

    monkeypatch.setattr(M, "KMeans", Fit)
    M.kmeans(blobs, 2, restarts=4)
    assert own == [True] * 4


def test_classes_over_years(spark, blobs):
    from pyspark.sql import functions as F

    years = blobs.withColumn("year", F.lit(2020)).unionByName(blobs.withColumn("year", F.lit(2021)).withColumn("embedding", F.transform("embedding", lambda x: 5 - x))).drop("label", "sample_id")
    out = M.classify_years(years, [2020, 2021], blobs, transition=True, changed=True, n_estimators=3)
    assert {r["changed"] for r in out["changed"].collect()} == {1} and out["legend"][1] == "a -> b"
    with pytest.raises(ValueError):
        M.classify_years(years, [2020], blobs)


def test_a_row_group_is_predicted_by_several_tasks(spark, blobs, tmp_path):
    blobs.drop("label").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    for fitted, predict in ((M.fit_classifier(blobs, n_estimators=2), M.classify), (M.fit_regressor(blobs.withColumn("label", blobs.sample_id % 2), n_estimators=2), M.regress)):
        out = predict(one, fitted)
        assert out.filter("code = 1" if "code" in out.columns else "value = 1").count() == 20
        tasks = fitted.bundle.model.transform(one).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(tasks) == 40 and max(tasks) < 40


def test_each_year_is_predicted_alone(spark, blobs, monkeypatch):
    from pyspark.sql import functions as F

    years = blobs.drop("label", "sample_id").crossJoin(spark.range(2019, 2022).selectExpr("cast(id AS int) AS year")).withColumn("embedding", F.when(F.col("year") == 2021, F.transform("embedding", lambda x: 5 - x)).otherwise(F.col("embedding")))
    asked, plain = [], M.classify

    def classify(pixels, *rest):
        asked.append(sorted(r["year"] for r in pixels.select("year").distinct().collect()))
        return plain(pixels, *rest)

    monkeypatch.setattr(M, "classify", classify)
    out = M.classify_years(years, [2019, 2021], blobs, transition=True, n_estimators=3)
    assert {r["transition"] for r in out["transition"].collect()} == {1, 2} and [2019] in asked and [2021] in asked


def test_compatibility():
    about = {"kind": "classifier", "n_bands": 64, "spark_version": "1.3.2"}
    assert not B.check_compatibility(about, 32, "classifier", "1.3.2").ok
    assert not B.check_compatibility(about, 64, "regressor", "1.3.2").ok
    assert not B.check_compatibility(about, 64, "classifier", "1.4.0").ok
    for other in ("1.3.5", None):
        found = B.check_compatibility(about, 64, "classifier", other)
        assert found.ok and found.warnings
    assert B.version_pair("1.3.2") == (1, 3) and B.version_pair("x") is None
    for kind, bands in (("other", 3), ("classifier", 0)):
        with pytest.raises(ValueError):
            B.save_model(B.Bundle(None, kind, bands, "rf"), "/tmp/never")


def test_subsample_is_the_same_from_few_rows_or_all(spark):
    df = spark.range(20000).selectExpr("'g' AS grid_id", "cast(id AS int) AS row", "0 AS col")
    from pyspark.sql import functions as F

    got = {r["row"] for r in M.subsample(df, 50).collect()}
    assert got == {r["row"] for r in df.orderBy(F.xxhash64("grid_id", "row", "col", F.lit(42))).limit(50).collect()}


def test_forest_finds_a_cut_that_quantiles_miss(spark):
    """Two classes with a wide gap between them in both bands, at a place that no 128th of the values is at."""
    rows = [(i, [float(i) if i < 997 else 1e6 + i, 1e6 + i if i < 997 else 3000.0 - i], int(i >= 997)) for i in range(2000)]
    df = spark.createDataFrame(rows, "sample_id long, embedding array<double>, label int")
    got = M.classify(df.drop("label"), M.fit_classifier(df, n_estimators=8, max_depth=1))
    assert [r["sample_id"] for r in got.collect() if r["code"] != (r["sample_id"] >= 997)] == []


def test_boosted_trees_find_a_cut_that_quantiles_miss(spark):
    """As above; the numbers of two classes and of three."""
    rows = [(i, [float(i) if i < 997 else 1e6 + i, 1e6 + i if i < 997 else 3000.0 - i], int(i >= 997), int(i >= 997) + int(i >= 1503)) for i in range(2000)]
    df = spark.createDataFrame(rows, "sample_id long, embedding array<double>, label int, three int")
    for label in ("label", "three"):
        got = M.classify(df, M.fit_classifier(df, label, algorithm="gb", n_estimators=3)).select("sample_id", "code", label)
        assert [r["sample_id"] for r in got.collect() if r["code"] != r[label]] == []
    assert [r["sample_id"] for r in M.regress(df, M.fit_regressor(df, algorithm="gb", n_estimators=3)).collect() if r["value"] != r["label"]] == []


def test_a_tree_reads_few_numbers_a_sample():
    """Classes beyond the first cost little: the search goes through the samples once for all classes, not once for each."""
    from time import perf_counter

    from gridlore.operators import forest as T

    rng, took = np.random.default_rng(0), {}
    data, w = T.Ranked(rng.normal(size=(4000, 16))), np.ones(4000, np.int64)
    for classes in (2, 60):
        y = rng.integers(0, classes, 4000)
        took[classes] = []
        for _ in range(3):
            began = perf_counter()
            T.grow(data, y, w, classes, 4, 16, 1, np.random.default_rng(1))
            took[classes].append(perf_counter() - began)
    assert min(took[60]) < 3 * min(took[2])


def test_trees_against_brute_force():
    from gridlore.operators import forest as T

    rng = np.random.default_rng(0)
    x, y = np.round(rng.normal(size=(60, 3)), 1), rng.integers(0, 3, 60)
    w = rng.integers(0, 3, 60)
    for target, classes in ((y, 3), (y.astype(float) ** 2, 0)):
        tree = T.grow(T.Ranked(x), target, w, classes, 1, 3, 2, rng)

        def score(side):
            t, v = target[side], w[side].astype(float)
            return (sum(v[t == c].sum() ** 2 for c in range(3)) if classes else ((t - np.average(target, weights=w)) * v).sum() ** 2) / v.sum()

        cuts = [(score(left & (w > 0)) + score(~left & (w > 0)), b, c) for b in range(3) for c in np.unique(x[w > 0][:, b])[:-1] for left in [x[:, b] <= c] if min((left & (w > 0)).sum(), (~left & (w > 0)).sum()) >= 2]
        left = x[:, tree.feature[0]] <= tree.cut[0]
        assert score(left & (w > 0)) + score(~left & (w > 0)) == pytest.approx(max(cuts)[0])
        whole = T.grow(T.Ranked(x), target, w, classes, None, 1, 1, rng)
        got = whole.value[whole.apply(x)]
        for i in np.flatnonzero(w):  # leaves are pure but for equal vectors
            same = (x == x[i]).all(axis=1) & (w > 0)
            if same.sum() == 1:
                assert (got[i].argmax() if classes else got[i][0]) == target[i]
