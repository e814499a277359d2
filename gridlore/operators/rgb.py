"""Renderings: principal components or three bands as bytes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions import vectors as V
from gridlore.functions.quantiles import quantiles
from gridlore.operators.similarity import literal

METHODS = ("pca", "bands")


def parse_bands(text: str) -> tuple[int, int, int]:
    """Three band numbers from 1, split by commas or semicolons, as indexes from 0."""
    try:
        bands = [int(t) - 1 for t in text.replace(";", ",").split(",") if t.strip()]
    except ValueError as e:
        raise ValueError(f"not band numbers: {text!r}") from e
    if len(bands) != 3 or min(bands) < 0:
        raise ValueError("three band numbers from 1 are needed")
    return tuple(bands)


def band_triplet(pixels: DataFrame, bands: Sequence[int] = (0, 1, 2), column: str = "embedding") -> DataFrame:
    """Columns c1, c2 and c3 from three bands (indexes from 0); a band out of range is an error."""
    if len(bands) != 3:
        raise ValueError("three bands are needed")
    picks = [F.when(F.size(column) <= b, F.raise_error(F.lit(f"no band {b + 1}")).cast("double")).otherwise(F.get(column, F.lit(b)).cast("double")).alias(f"c{i + 1}") for i, b in enumerate(bands)]
    return pixels.select("*", *picks)


@dataclass(frozen=True)
class Components:
    """Principal axes: unit rows, the entry of largest size positive."""

    mean: list[float]
    axes: list[list[float]]
    variance: list[float]


def _moments(pixels: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance sums: a fixed number of values a partition, merged in tasks."""
    size = pixels.select(F.size(column).alias("n")).filter("n > 0").limit(1).collect()
    if not size:
        return 0, np.zeros(0), np.zeros((0, 0))
    bands = size[0]["n"]

    def partial(batches):
        import pyarrow as pa

        n, mean, sums = 0, np.zeros(bands), np.zeros((bands, bands))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, bands)
            m, own = len(x), x.mean(axis=0)
            centred = x - own
            shift = own - mean
            sums += centred.T @ centred + np.outer(shift, shift) * (n * m / (n + m))
            mean += shift * (m / (n + m))
            n += m
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "sums": [sums.ravel().tolist()]})

    def merged(batches):
        import pyarrow as pa

        n, mean, sums = 0, np.zeros(bands), np.zeros((bands, bands))
        for batch in batches:
            for m, own, more in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "sums"))):
                own = np.array(own)
                shift = own - mean
                sums += np.array(more).reshape(bands, bands) + np.outer(shift, shift) * (n * m / (n + m))
                mean = mean + shift * (m / (n + m))
                n += m
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "sums": [sums.ravel().tolist()]})

    schema = "n long, mean array<double>, sums array<double>"
    parts = pixels.select(V.as_double(column).alias("e")).mapInArrow(partial, schema).repartition(16).mapInArrow(merged, schema)
    n, mean, sums = 0, np.zeros(bands), np.zeros((bands, bands))
    for r in parts.collect():  # sixteen rows at most
        own = np.array(r["mean"])
        shift = own - mean
        sums += np.array(r["sums"]).reshape(bands, bands) + np.outer(shift, shift) * (n * r["n"] / (n + r["n"]))
        mean = mean + shift * (r["n"] / (n + r["n"]))
        n += r["n"]
    return n, mean, sums


def fit_components(pixels: DataFrame, k: int = 3, nodata: float | None = None, column: str = "embedding") -> Components:
    """The first axes of all valid pixels (not of a sample); fewer where rows or bands are fewer."""
    n, mean, sums = _moments(pixels.filter(V.valid(column, nodata)), column)
    if not n:
        raise ValueError("no valid pixel")
    keep = max(1, min(k, n, len(mean)))
    value, vector = np.linalg.eigh(sums / max(n - 1, 1))
    axes = vector[:, ::-1][:, :keep].T
    lead = np.abs(axes).argmax(axis=1)
    axes = axes * np.sign(axes[np.arange(keep), lead])[:, None]
    return Components(mean.tolist(), axes.tolist(), np.maximum(value[::-1][:keep], 0).tolist())


def project(pixels: DataFrame, fitted: Components, column: str = "embedding") -> DataFrame:
    """Columns c1, c2 and c3: centred scores; 0 for an axis that does not exist."""
    scores = [V.dot(V.as_double(column), literal(a)) - F.lit(float(np.dot(fitted.mean, a))) for a in fitted.axes]
    return pixels.select("*", *((scores[i] if i < len(scores) else F.lit(0.0)).alias(f"c{i + 1}") for i in range(3)))


def stretch_bounds(scores: DataFrame, low: float = 2.0, high: float = 98.0, channels: Sequence[str] = ("c1", "c2", "c3"), exact: bool = True) -> list[tuple[float, float]]:
    """The percentiles of each channel, linear between ranks; exact=False uses Spark's bounded-memory sketch."""
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must be 0 <= low < high <= 100")
    if exact:
        rows = [quantiles(scores, c, (low / 100, high / 100)) for c in channels]
    else:
        row = scores.agg(*(F.percentile_approx(V.finite_or_null(c), [low / 100, high / 100]).alias(c) for c in channels)).first()
        rows = [row[c] or [None, None] for c in channels]
    return [(float("nan"), float("nan")) if r[0] is None else (r[0], r[1]) for r in rows]


def to_byte(value: Column | str, low: float, high: float) -> Column:
    """0..255, rounded half to even."""
    value = F.col(value) if isinstance(value, str) else value
    share = (value - F.lit(low)) / F.lit(max(high - low, 1e-12))
    return F.rint(F.lit(255.0) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).cast("short")


def render(pixels: DataFrame, method: str = "pca", bands: Sequence[int] = (0, 1, 2), low: float = 2.0, high: float = 98.0, nodata: float | None = None, fill: int = 0, column: str = "embedding") -> DataFrame:
    """The table with bytes red, green and blue; `fill` for invalid pixels."""
    name = method.strip().lower()
    if name not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    ok = V.valid(column, nodata)
    good = pixels.filter(ok)
    if good.isEmpty():
        raise ValueError("no valid pixel")
    make = (lambda df: band_triplet(df, bands, column)) if name == "bands" else (lambda df, fitted=fit_components(good, 3, None, column): project(df, fitted, column))
    limits = stretch_bounds(make(good), low, high)
    out = make(pixels)
    return out.withColumns({colour: F.when(ok, to_byte(f"c{i + 1}", *limits[i])).otherwise(F.lit(fill)).cast("short") for i, colour in enumerate(("red", "green", "blue"))}).drop("c1", "c2", "c3")
