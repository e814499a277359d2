"""Yearly pixels that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlore.operators.similarity import similarity_map, threshold_mask
from gridlore.sources.pixels import SCHEMA


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def similarity_stream(pixels: DataFrame, reference: Sequence[float], threshold: float = 0.0, nodata: float | None = None) -> DataFrame:
    """The batch map on a stream: it keeps no state."""
    out = similarity_map(pixels, reference, nodata=nodata)
    return threshold_mask(out, threshold) if threshold > 0 else out


def trajectory_stream(pixels: DataFrame, metric: str = "cosine") -> DataFrame:
    """grid_id, row, col, year, step and total: each new year's distance from the last year seen, and the sum so far.

    State is one vector a pixel; years must arrive in order, earlier ones are passed over.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        year, last, total = state.get if state.exists else (None, None, 0.0)
        rows = pd.concat(list(batches)).sort_values("year")
        out = []
        for y, e in zip(rows["year"], rows["embedding"]):
            now = np.asarray(e, dtype=np.float64)
            if year is not None and y <= year:
                continue
            if year is not None:
                a = np.asarray(last)
                if metric == "euclidean":
                    step = float(np.linalg.norm(now - a))
                else:
                    step = 1 - float(a @ now) / (max(np.linalg.norm(a), 1e-12) * max(np.linalg.norm(now), 1e-12))
                total += step
                out.append((*key, int(y), step, total))
            year, last = int(y), now.tolist()
        state.update((year, last, total))
        yield pd.DataFrame(out, columns=["grid_id", "row", "col", "year", "step", "total"])

    return pixels.groupBy("grid_id", "row", "col").applyInPandasWithState(run, "grid_id string, row int, col int, year int, step double, total double", "year int, embedding array<double>, total double", "append", GroupStateTimeout.NoTimeout)
