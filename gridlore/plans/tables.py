"""The driver's embeddings as a pixel table: five years of a grid 20 wide, in one grid."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions.geometry import Grid

WIDTH = 20
#: as high as it is at least; grid() makes it as high as its table
GRID = Grid("g", "EPSG:3577", WIDTH, 200, 0.0, 10.0, 0.0, 1000.0, 0.0, -10.0, None, 64)

#: the same table in SQL; e is the vector as doubles
SQL = """p AS (
  SELECT 'g' AS grid_id, vec_id, (2017 + vec_id % 5)::INT AS year, ((vec_id // 5) // 20)::INT AS row,
         ((vec_id // 5) % 20)::INT AS col, embedding::DOUBLE[] AS e, label
  FROM embeddings)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = F.expr("vec_id div 5")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.lit("g").alias("grid_id"),
        (F.lit(2017) + F.col("vec_id") % 5).cast("int").alias("year"),
        F.expr(f"cast((vec_id div 5) div {WIDTH} as int)").alias("row"),
        (pixel % WIDTH).cast("int").alias("col"),
        "embedding",
        "vec_id",
        "label",
    )


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """GRID, with more rows where the table has pixels below its last."""
    last = pixels(spark, sf_dir).agg(F.max("row")).first()[0]
    return replace(GRID, height=max(GRID.height, (last or 0) + 1))


def one_year(spark: SparkSession, sf_dir: str, year: int = 2021) -> DataFrame:
    return pixels(spark, sf_dir).filter(F.col("year") == year)
