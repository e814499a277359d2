import pytest

from gridlore.sources import jobs


def test_retry():
    calls, waits = [], []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert jobs.with_retry(fails_twice, sleep=waits.append) == "ok" and waits == [2, 4]
    with pytest.raises(OSError):
        jobs.with_retry(lambda: (_ for _ in ()).throw(OSError), remote=False, sleep=waits.append)
    calls.clear()

    def stops():
        calls.append(1)
        raise jobs.Cancelled

    with pytest.raises(jobs.Cancelled):
        jobs.with_retry(stops, sleep=waits.append)
    assert len(calls) == 1


def test_groups_and_settings(spark):
    with jobs.job_group(spark, "g1") as cancel:
        assert spark.range(5).count() == 5 and 0 <= jobs.progress(spark, "g1") <= 1
        cancel()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with jobs.settings(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
