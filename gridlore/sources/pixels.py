"""Pixel tables as Parquet: one row a pixel and year, one folder a year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions import vectors as V

SCHEMA = "grid_id string, year int, row int, col int, embedding array<float>"


def read_pixels(spark: SparkSession, path: str, years: Sequence[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The table, some years (folders are skipped) and a window (row0, row1, col0, col1; the last not included), both pushed to the scan."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.filter(F.col("year").isin([int(y) for y in years]))
    if window is not None:
        r0, r1, c0, c1 = window
        df = df.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return df


def write_pixels(df: DataFrame, path: str, files_a_year: int | None = None, mode: str = "overwrite") -> None:
    """Write by year, sorted by place within a file, so that windows skip row groups; overwriting replaces the years that df has."""
    keys = ["year", "row", "col"]
    laid = df.repartitionByRange(files_a_year, *keys) if files_a_year else df.repartitionByRange(*keys)
    laid.sortWithinPartitions(*keys).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def to_disk_values(df: DataFrame, column: str, kind: str) -> DataFrame:
    """NULL as the sentinel of the kind of map: 'change' and 'similarity' -9999, 'classes' -1, 'confidence' and 'regression' NaN, 'mask' 0."""
    sentinel, as_type = {"change": (V.FILL, "float"), "similarity": (V.FILL, "float"), "classes": (-1, "int"), "confidence": (float("nan"), "float"), "regression": (float("nan"), "float"), "mask": (0, "short")}[kind]
    return df.withColumn(column, V.to_sentinel(column, sentinel, as_type))


def export(df: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write in the format that the path's ending names, or the one given."""
    ending = path.rsplit(".", 1)[-1].lower()
    chosen = fmt or {"csv": "csv", "json": "json", "orc": "orc"}.get(ending, "parquet")
    writer = df.write.mode("overwrite").format(chosen)
    (writer.option("header", "true") if chosen == "csv" else writer).save(path)
    return path


def first_readable(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """The first candidate that can be read, lazily; text after a pipe character is an option of another program and left off."""
    tried = list(dict.fromkeys(x for c in candidates if c for x in (c.split("|", 1)[0], c)))
    for path in tried:
        try:
            return spark.read.parquet(path)
        except Exception:  # noqa: BLE001 - the next one
            continue
    raise FileNotFoundError(f"none can be read: {', '.join(tried)}")


def safe_stem(name: str) -> str:
    """A file name of letters, digits, dots, dashes and underscores."""
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in name).strip("_") or "layer"
