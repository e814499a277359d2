"""Change over years: one pass that groups a pixel's years, no self-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions import vectors as V

MODES = ("pairwise", "trajectory", "anomaly")
PIXEL = ("grid_id", "row", "col")


def _check(metric: str, mode: str = "pairwise") -> str:
    V.distance(F.lit(None), F.lit(None), metric)
    name = mode.strip().lower()
    if name not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    return name


def series(pixels: DataFrame, years: Sequence[int] | None = None, nodata: float | None = None, keys: Sequence[str] = PIXEL, ends_only: bool = False, complete: bool = False) -> DataFrame:
    """Each pixel's vectors in order of year (array of year, embedding), and whether it is valid in every one of the years.

    A pixel that misses one of the years is not valid, and with complete=True has no row.  One shuffle on the
    pixel; a group is as long as there are years.  ends_only: of the years in
    between only their validity is shuffled, not their vectors.
    """
    used = pixels if years is None else pixels.filter(F.col("year").isin([int(y) for y in years]))
    if years is not None:
        first, last, wanted = min(years), max(years), len(set(years))
    else:
        first, last, wanted = used.agg(F.min("year"), F.max("year"), F.count_distinct("year")).first()
    if wanted < 2:
        raise ValueError("change needs two years or more")
    vector = F.when(F.col("year").isin(first, last), F.col("embedding")) if ends_only else F.col("embedding")
    slim = used.select(*keys, "year", vector.alias("embedding"), V.valid("embedding", nodata).alias("_ok"))
    grouped = slim.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", "embedding"))).alias("years"), F.every("_ok").alias("_ok"))
    # a distinct count inside the aggregation would shuffle everything twice
    every = F.size(F.array_distinct("years.year")) == wanted
    if complete:
        grouped = grouped.filter(every)
    return grouped.select(*keys, "years", (F.col("_ok") & every).alias("valid"))


def _mean_vector(stack):
    """The band by band mean of an array of vectors."""
    first = stack[0]["embedding"]
    zero = F.transform(first, lambda x: F.lit(0.0))
    total = F.aggregate(stack, zero, lambda s, v: F.zip_with(s, v["embedding"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.size(stack))


def change(pixels: DataFrame, metric: str = "cosine", mode: str = "pairwise", years: Sequence[int] | None = None, nodata: float | None = None, keys: Sequence[str] = PIXEL, complete: bool = False) -> DataFrame:
    """keys and value (float; NULL where any year, also one in between, is invalid or, unless complete=True leaves such pixels out, has no row).

    pairwise: first against last year.  trajectory: sum over neighbouring years.
    anomaly: last year against the mean of all years, the last included.
    """
    name = _check(metric, mode)
    grouped = series(pixels, years, nodata, keys, ends_only=name == "pairwise", complete=complete)
    stack = F.col("years")
    first, last = stack[0]["embedding"], F.element_at(stack, -1)["embedding"]
    if name == "pairwise":
        value = V.distance(first, last, metric)
    elif name == "anomaly":
        value = V.distance(last, _mean_vector(stack), metric)
    else:
        steps = F.zip_with(F.slice(stack, 1, F.size(stack) - 1), F.slice(stack, 2, F.size(stack) - 1), lambda a, b: V.distance(a["embedding"], b["embedding"], metric))
        value = F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)
    return grouped.select(*keys, F.when(F.col("valid"), value).cast("float").alias("value"))


def consecutive(pixels: DataFrame, metric: str = "cosine", nodata: float | None = None, keys: Sequence[str] = PIXEL, years: Sequence[int] | None = None) -> DataFrame:
    """keys, year_from, year_to and value for each neighbouring pair of a pixel's years; NULL where either is invalid."""
    _check(metric)
    used = pixels if years is None else pixels.filter(F.col("year").isin([int(y) for y in years]))
    order = Window.partitionBy(*keys).orderBy("year")
    step = used.withColumn("_ok", V.valid("embedding", nodata)).select(*keys, F.lag("year").over(order).alias("year_from"), F.col("year").alias("year_to"), F.lag("embedding").over(order).alias("_a"), F.col("embedding").alias("_b"), (F.lag("_ok").over(order) & F.col("_ok")).alias("_ok"))
    return step.filter("year_from IS NOT NULL").select(*keys, "year_from", "year_to", F.when(F.col("_ok"), V.distance("_a", "_b", metric)).cast("float").alias("value"))


def baseline(pixels: DataFrame, keys: Sequence[str] = PIXEL) -> DataFrame:
    """The mean vector of each pixel over its years."""
    return pixels.groupBy(*keys).agg(F.collect_list(F.struct("embedding")).alias("s")).select(*keys, _mean_vector(F.col("s")).alias("embedding"))


def require_any(values: DataFrame, column: str = "value") -> DataFrame:
    """The table itself, or an error if no row has a value."""
    if values.filter(F.col(column).isNotNull()).isEmpty():
        raise ValueError("no pixel is valid in every year")
    return values
