"""Exact quantiles, linear between ranks, of any number of rows.

Spark's exact percentile holds all distinct values in one task, so it serves
small tables only.  A large one is histogrammed over its range, and only the
bins that hold a wanted rank are looked at again, until each is few values or
one; a pass sends a bounded number of rows to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 1_000_000
FEW = 100_000
BINS = 2048


def _ranked(values: DataFrame, low: float, high: float, ranks: Sequence[int], few: int) -> dict[int, float]:
    """The values at ranks (from 0) among the rows from low to high."""
    held = values.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
    place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1)) if high > low else F.lit(0)
    bins = held.groupBy(place.cast("int").alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    out, before = {}, 0
    for b in bins:
        own = [r for r in ranks if before <= r < before + b["n"]]
        if own and b["lo"] == b["hi"]:
            out |= {r: b["lo"] for r in own}
        elif own and b["n"] <= few:
            rows = held.filter((F.col("v") >= F.lit(b["lo"])) & (F.col("v") <= F.lit(b["hi"]))).orderBy("v").toArrow().column("v").to_pylist()
            out |= {r: rows[r - before] for r in own}
        elif own:
            deeper = _ranked(held, b["lo"], b["hi"], [r - before for r in own], few)
            out |= {r: deeper[r - before] for r in own}
        before += b["n"]
    return out


def quantiles(df: DataFrame, column: str, shares: Sequence[float], small: int = SMALL, few: int = FEW) -> list[float | None]:
    """The quantiles of a column's finite values; None for an empty one."""
    from gridlore.functions.vectors import finite_or_null

    values = df.select(finite_or_null(column).alias("v")).filter("v IS NOT NULL")
    about = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not about["n"]:
        return [None] * len(shares)
    if about["n"] <= small:
        return list(values.agg(F.percentile("v", F.array(*(F.lit(float(s)) for s in shares))).alias("q")).first()["q"])
    at = [s * (about["n"] - 1) for s in shares]
    known = _ranked(values, about["lo"], about["hi"], sorted({r for a in at for r in (math.floor(a), math.ceil(a))}), few)
    return [known[math.floor(a)] + (known[math.ceil(a)] - known[math.floor(a)]) * (a - math.floor(a)) for a in at]
