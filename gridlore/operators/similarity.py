"""Cosine similarity of pixels to reference vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions import vectors as V

AGGREGATIONS = ("mean", "medoid")


def gather_seeds(pixels: DataFrame, seeds: DataFrame, keys: Sequence[str] = ("grid_id", "row", "col"), skip_invalid: bool = False, nodata: float | None = None) -> DataFrame:
    """The pixels at distinct seed places. Seeds without a valid vector count too unless skip_invalid."""
    got = pixels.join(seeds.select(*keys).distinct(), list(keys))
    return got.filter(V.valid("embedding", nodata)) if skip_invalid else got


def _by_band(seeds: DataFrame, column: str, how) -> list[float] | None:
    """The vector of each band's mean or sum: one row a band reaches the driver."""
    rows = seeds.select(F.posexplode(V.as_double(column)).alias("band", "v")).groupBy("band").agg(how("v").alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["band"])] or None


def aggregate_seeds(seeds: DataFrame, method: str = "mean", order: Sequence[str] = ("row", "col"), column: str = "embedding") -> list[float]:
    """One unit reference vector from seed vectors.

    mean: of the raw vectors, then at unit length.  medoid: the seed with the
    greatest sum of cosines to all seeds, the first in `order` of those equal to
    nine places, however many seeds there are; as that sum is one dot product with
    the sum of all unit vectors, it takes two passes and no pairs.
    """
    name = method.strip().lower()
    if name not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {method!r}; known: {', '.join(AGGREGATIONS)}")
    if name == "mean":
        vector = _by_band(seeds, column, F.avg)
    else:
        unit = seeds.withColumn("_unit", V.normalise(column))
        total = _by_band(unit, "_unit", F.sum)
        best = [] if total is None else unit.withColumn("_score", V.dot("_unit", literal(total))).orderBy(F.desc(F.round("_score", 9)), *order).select(V.as_double(column).alias("v")).limit(1).collect()
        vector = best[0]["v"] if best else None
    if vector is None:
        raise ValueError("no seed vectors")
    length = max(float(np.linalg.norm(vector)), V.EPS)
    return [x / length for x in vector]


def literal(vector: Sequence[float]) -> Column:
    """A vector as one array constant."""
    return F.lit([float(x) for x in vector]).cast("array<double>")


def similarity_map(pixels: DataFrame, references: Sequence[float] | Sequence[Sequence[float]], rescale: bool = True, nodata: float | None = None, column: str = "embedding", output: str = "similarity") -> DataFrame:
    """The greatest cosine to any reference, as (x + 1) / 2 if rescaled; NULL for invalid pixels.

    References are few and given on the driver, so they are constants of the
    projection: no join, no shuffle.
    """
    stack = np.atleast_2d(np.asarray(references, dtype=np.float64))
    if not stack.size:
        raise ValueError("no reference vectors")
    units = stack / np.maximum(np.linalg.norm(stack, axis=1, keepdims=True), V.EPS)
    length = V.norm(column)
    scores = [V.dot(column, literal(u)) / length for u in units]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    if rescale:
        best = (best + 1) / 2
    return pixels.withColumn(output, F.when(V.valid(column, nodata), best).cast("float"))


def similarity_map_vectorised(pixels: DataFrame, references: Sequence[Sequence[float]], rescale: bool = True, nodata: float | None = None, column: str = "embedding", output: str = "similarity") -> DataFrame:
    """The same map by one matrix product an Arrow batch; faster with many references."""
    stack = np.atleast_2d(np.asarray(references, dtype=np.float64))
    units = stack / np.maximum(np.linalg.norm(stack, axis=1, keepdims=True), V.EPS)

    @F.pandas_udf("float")
    def best(e: pd.Series) -> pd.Series:
        if not len(e):
            return pd.Series([], dtype="float32")
        m = np.stack(e.to_numpy()).astype(np.float64)
        if m.shape[1] != units.shape[1]:
            raise ValueError("vectors differ in their number of bands")
        top = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), V.EPS) @ units.T).max(axis=1)
        return pd.Series(((top + 1) / 2 if rescale else top).astype(np.float32))

    # a batch needs rows of one length: what is invalid goes in as a zero vector and comes out as NULL
    ok = V.valid(column, nodata)
    usable = F.when(ok, F.col(column)).otherwise(F.lit([0.0] * stack.shape[1]).cast(pixels.schema[column].dataType))
    return pixels.withColumn(output, F.when(ok, best(usable)))


def similarity_to_table(pixels: DataFrame, references: DataFrame, keys: Sequence[str], rescale: bool = True, nodata: float | None = None) -> DataFrame:
    """The map for a table of references (ref_id, embedding): reduced to a block of vectors on the driver, as references are a small, given set."""
    block = [r["embedding"] for r in references.select(V.as_double("embedding").alias("embedding")).collect()]
    return similarity_map(pixels, block, rescale, nodata).select(*keys, "similarity")


def threshold_mask(scores: DataFrame, threshold: float, column: str = "similarity", output: str = "mask") -> DataFrame:
    """1 where the score reaches the threshold, both as float; else 0, also for NULL."""
    value = V.finite_or_null(column).cast("float")
    return scores.withColumn(output, F.coalesce(value >= F.lit(threshold).cast("float"), F.lit(False)).cast("short"))


def search(pixels: DataFrame, seeds: DataFrame, aggregation: str = "mean", rescale: bool = True, threshold: float = 0.0, nodata: float | None = None, keys: Sequence[str] = ("grid_id", "row", "col"), skip_invalid_seeds: bool = False) -> DataFrame:
    """The whole operator: seed pixels -> reference -> map, and a mask if the threshold is above 0."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be from 0 to 1")
    reference = aggregate_seeds(gather_seeds(pixels, seeds, keys, skip_invalid_seeds, nodata), aggregation, order=keys)
    out = similarity_map(pixels, reference, rescale, nodata)
    return threshold_mask(out, threshold) if threshold > 0 else out


def top_k(pixels: DataFrame, reference: Sequence[float], k: int, order: Sequence[str], nodata: float | None = None) -> DataFrame:
    """The k most similar valid pixels; equal scores by `order`."""
    scored = similarity_map(pixels, reference, rescale=False, nodata=nodata).filter("similarity IS NOT NULL")
    return scored.orderBy(F.desc("similarity"), *order).limit(k)
