import numpy as np
import pytest

from gridlore.operators import labels as L


def codes(spark, *pairs, names="label int, prediction int"):
    return spark.createDataFrame(list(pairs), names)


def test_encode(spark):
    df = spark.createDataFrame([(0, "water"), (1, "urban"), (2, "water"), (3, "tree")], "i int, label string")
    out, classes = L.encode(df)
    assert classes == ["tree", "urban", "water"] and [r["code"] for r in out.orderBy("i").collect()] == [2, 1, 2, 0]
    out, classes = L.encode(spark.createDataFrame([(0, 5), (1, 1), (2, 5), (3, 9)], "i int, label int"))
    assert classes == [1, 5, 9] and [r["code"] for r in out.orderBy("i").collect()] == [1, 0, 1, 2]
    for bad in (df.limit(0), spark.createDataFrame([(None,)], "label string")):
        with pytest.raises(ValueError):
            L.encode(bad)


def counts(spark, values, k):
    df = L.class_counts(spark.createDataFrame([(v,) for v in values], "code int"), k)
    return df, [r["n"] for r in df.orderBy("code").collect()]


def test_counts_and_balance(spark):
    assert counts(spark, [0, 2, 2, 0, 0], 3)[1] == [3, 0, 2]
    assert counts(spark, [0, 1, 1], 4)[1] == [1, 2, 0, 0]
    with pytest.raises(Exception, match="range"):
        counts(spark, [3], 3)
    b = L.class_balance(counts(spark, [0] * 100 + [1] * 5, 2)[0], ["major", "rare"])
    assert (b["ratio"], b["imbalanced"], b["rarest"], b["commonest"]) == (20, True, "rare", "major")
    b = L.class_balance(counts(spark, [0, 0, 0], 2)[0], ["a", "b"])
    assert b["empty"] == ["b"] and b["ratio"] == float("inf") and b["imbalanced"]
    assert "a: 3" in L.balance_text(b, ["a", "b"])


def test_folds(spark):
    df = spark.range(10).withColumnRenamed("id", "sample_id")
    got = L.folds(df, 3).collect()
    assert sorted(r["fold"] for r in got) == [0] * 4 + [1] * 3 + [2] * 3
    plain = L.folds(spark.range(6).withColumnRenamed("id", "sample_id"), 3, None).orderBy("sample_id").collect()
    assert [r["fold"] for r in plain] == [0, 0, 1, 1, 2, 2]
    mixed = spark.createDataFrame([(i, "A" if i < 9 else "B") for i in range(15)], "sample_id long, label string")
    for r in L.folds(mixed, 3, within="label").groupBy("fold", "label").count().collect():
        assert r["count"] == (3 if r["label"] == "A" else 2)
    with pytest.raises(Exception, match="fewer"):
        L.folds(mixed.limit(10), 3, within="label").collect()


def test_out_of_fold_mean(spark):
    from pyspark.sql import functions as F

    df = L.folds(spark.createDataFrame([(i, float(i)) for i in range(12)], "sample_id long, y double"), 4).persist()
    got = L.out_of_fold(df, 4, lambda train, test: test.crossJoin(F.broadcast(train.agg(F.avg("y").alias("prediction"))))).collect()
    rows = {r["sample_id"]: r for r in got}
    assert len(got) == 12
    for r in got:
        assert r["prediction"] == pytest.approx(np.mean([x["y"] for x in rows.values() if x["fold"] != r["fold"]]))


def test_confusion_and_metrics(spark):
    table = L.confusion(codes(spark, (0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 0)), 3)
    assert L.confusion_matrix(table) == [[1, 1, 0], [0, 2, 0], [1, 0, 1]]
    with pytest.raises(Exception, match="range"):
        L.confusion(codes(spark, (0, 3)), 3).collect()

    def of(matrix):
        rows = [(i, j, n) for i, r in enumerate(matrix) for j, n in enumerate(r)]
        t = spark.createDataFrame(rows, "truth int, predicted int, n long")
        return L.metrics(t).first(), L.class_metrics(t).orderBy("code").collect()

    m, per = of([[1, 1], [0, 2]])
    assert m["accuracy"] == 0.75 and [p["precision"] for p in per] == pytest.approx([1, 2 / 3]) and [p["recall"] for p in per] == [0.5, 1]
    assert m["macro_recall"] == 0.75 and m["weighted_recall"] == 0.75
    m, per = of([[4, 0], [0, 0]])
    assert [per[1][c] for c in ("precision", "recall", "f1")] == [0, 0, 0] and m["accuracy"] == 1
    assert "Confusion" in L.accuracy_text([p.asDict() for p in per], m.asDict(), [[4, 0], [0, 0]], ["a", "b"])


def test_regression(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (4.0, 4.0), (6.0, 8.0)], "label double, prediction double")
    m = L.regression_metrics(df).first()
    assert (m["r2"], m["rmse"], m["mae"], m["n"]) == (pytest.approx(0.8), 1, 0.5, 4)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert L.regression_metrics(flat).first()["r2"] == 0
    with pytest.raises(Exception, match="no predictions"):
        L.regression_metrics(flat.limit(0)).collect()
    assert "RMSE" in L.regression_text(m.asDict(), [m.asDict()])


def maps(spark, first, last):
    make = lambda m: spark.createDataFrame([("g", r, c, v) for r, row in enumerate(m) for c, v in enumerate(row)], "grid_id string, row int, col int, code int")
    return make(first), make(last)


def test_transitions(spark):
    a, b = maps(spark, [[0, 1], [2, -1]], [[0, 2], [1, 1]])
    got = {(r["row"], r["col"]): r["transition"] for r in L.transition_codes(a, b, 3).collect()}
    assert got == {(0, 0): 0, (0, 1): 5, (1, 0): 7, (1, 1): -1}
    a, b = maps(spark, [[0, 9]], [[1, 0]])
    assert sorted(r["transition"] for r in L.transition_codes(a, b, 2, nodata=9).collect()) == [1, 9]
    with pytest.raises(Exception, match="range"):
        L.transition_codes(*maps(spark, [[3]], [[0]]), 3).collect()
    a, b = maps(spark, [[0, 1], [2, -1]], [[0, 2], [2, 1]])
    assert {(r["row"], r["col"]): r["changed"] for r in L.changed_mask(a, b).collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): -1}
    names = L.transition_labels(["water", "veg", "urban"])
    assert len(names) == 9 and (names[0], names[5], names[6]) == ("water -> water", "veg -> urban", "urban -> water")


def test_search(spark):
    grid = {"a": [1, 2], "b": [3, 4]}
    assert len({tuple(p.items()) for p in L.parameter_grid(grid, 10)}) == 4
    wide = {"a": [1, 2, 3], "b": [1, 2, 3]}
    assert L.parameter_grid(wide, 4) == L.parameter_grid(wide, 4) and len(L.parameter_grid(wide, 4)) == 4
    found = L.randomised_search({"n": [50, 100, 200, 400]}, lambda p: -abs(p["n"] - 200), 10)
    assert found["params"] == {"n": 200} and "*" in L.search_text(found)
    assert L.randomised_search({"n": [1]}, lambda p: None) is None
    table = spark.createDataFrame([(1, 0.8), (0, 0.8), (2, 0.1), (3, None)], "trial int, score double")
    assert L.best_trial(table).first()["trial"] == 0 and L.best_trial(table, False).first()["trial"] == 2
    assert L.resolve_folds(0, 100) is None and L.resolve_folds(1, 100) == 2 and L.resolve_folds(5, 4) is None and L.tuning_folds(0) == 3
