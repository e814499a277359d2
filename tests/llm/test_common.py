import pytest
from pyspark.errors import PySparkException

from gridlore.llm import common, pii


def test_stash_discard_and_sweep(spark):
    a, b = (common.stash(spark.range(3), "t") for _ in range(2))
    assert a.count() == b.count() == 3 and a._gridlore_path != b._gridlore_path
    common.discard(a)
    common.sweep(spark)
    with pytest.raises(PySparkException):
        spark.read.parquet(b._gridlore_path).count()
    assert common.stash(spark.range(0), "t").count() == 0


def test_lean_tables_are_broadcast_by_size(spark, monkeypatch):
    plan = lambda df: spark.range(9).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(common.lean(spark.range(3), "t"))
    assert "broadcast" in plan(common.lean(spark.range(0), "t"))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 20)  # {"id":0} three times
    assert "broadcast" not in plan(common.lean(spark.range(3), "t")) and "broadcast" in plan(common.lean(spark.range(2), "t"))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert "broadcast" not in plan(common.lean(spark.range(3), "t"))


def test_surrogates_by_both_joins(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"mail a{i % 7}@b.com or +1 200 555 01{i % 50:02}") for i in range(200)], "doc_id long, text string")
    told = []
    for bound in (1 << 20, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        told.append(sorted(map(tuple, pii.replace(rows).collect())))
    assert told[0] == told[1] and len(told[0]) == 200


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Far:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default):
            return default

    class Session:
        sparkContext = Far()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
