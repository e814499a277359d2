"""Retries, cancelling and progress of Spark jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Cancelled(RuntimeError):
    """The caller asked to stop; never tried again."""


def with_retry(call: Callable[[], T], attempts: int = 3, wait: float = 2.0, remote: bool = True, sleep: Callable[[float], Any] = time.sleep) -> T:
    """Call again after an error, each time waiting a step longer; only what is remote is worth it."""
    for i in range(1, (attempts if remote else 1) + 1):
        try:
            return call()
        except Cancelled:
            raise
        except Exception:
            if i == (attempts if remote else 1):
                raise
            sleep(wait * i)
    raise AssertionError("unreachable")


@contextmanager
def job_group(spark: SparkSession, name: str, description: str = "") -> Iterator[Callable[[], None]]:
    """Run Spark jobs under a name; the value is a function that cancels them, from any thread."""
    sc = spark.sparkContext
    sc.setJobGroup(name, description or name, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(name)
    finally:
        sc._jsc.clearJobGroup()


def progress(spark: SparkSession, name: str) -> float:
    """The share of the tasks of a group's running stages that are done."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(name):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if s := tracker.getStageInfo(stage):
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done / total if total else 0.0


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """SQL settings for a while (dots written as double underscores); what was there comes back."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
