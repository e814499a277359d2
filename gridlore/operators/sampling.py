"""Features to pixels, and pixel values at features.

features: feature_id, geom_type ('point', 'line' or 'polygon'), rings
(array<array<struct<x,y>>>: a point's or line's vertices as one ring) and
attributes, in the grid's coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import geometry as G
from gridlore.functions import vectors as V

CELL_CAP = 4_000_000
RINGS = "array<array<struct<x:double,y:double>>>"


def point_features(table: DataFrame, x: str, y: str, feature_id: str = "feature_id") -> DataFrame:
    """A table of coordinates as point features; rows without coordinates are left out."""
    rest = [c for c in table.columns if c not in {x, y, feature_id}]
    rings = F.array(F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    return table.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(feature_id).alias("feature_id"), F.lit("point").alias("geom_type"), rings.alias("rings"), *rest)


def reproject(features: DataFrame, crs: str) -> DataFrame:
    """Features in degrees to the grid's coordinates; a vertex that cannot be projected takes its feature out."""
    moved = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(*(c.alias(n) for c, n in zip(G.project(p["x"], p["y"], crs), ("x", "y"))))))
    out = features.withColumn("rings", moved)
    return out.filter(F.forall(F.flatten("rings"), lambda p: V.finite(p["x"]) & V.finite(p["y"])))


def feature_pixels(features: DataFrame, grid: G.Grid, across: bool = False) -> DataFrame:
    """feature_id, row and col: every vertex of a point feature; for others the cells whose centre lies inside, or else the cell of the centroid.

    Distinct within a feature; with across=True distinct over all features (then
    only row and col).  A feature whose bounding box has more than CELL_CAP cells
    is an error, as a mistaken unit would otherwise fill the cluster.
    """
    used = features.filter(F.col("rings").isNotNull() & (F.size(F.flatten("rings")) > 0)).select("feature_id", "geom_type", F.col("rings").cast(RINGS).alias("rings"))
    cell = lambda x, y: (G.row_of(y, F.lit(grid.origin_y), F.lit(grid.pixel_h)).alias("row"), G.column_of(x, F.lit(grid.origin_x), F.lit(grid.pixel_w)).alias("col"))
    points = used.filter("geom_type = 'point'").select("feature_id", F.explode(F.flatten("rings")).alias("p")).select("feature_id", *cell(F.col("p.x"), F.col("p.y")))
    vertices = F.flatten("rings")
    shapes = used.filter("geom_type <> 'point'").withColumns({n: f(F.transform(vertices, _axis(c))) for n, f, c in (("x0", F.array_min, "x"), ("x1", F.array_max, "x"), ("y0", F.array_min, "y"), ("y1", F.array_max, "y"))})
    rows = [G.row_of(F.col(c), F.lit(grid.origin_y), F.lit(grid.pixel_h)) for c in ("y0", "y1")]
    cols = [G.column_of(F.col(c), F.lit(grid.origin_x), F.lit(grid.pixel_w)) for c in ("x0", "x1")]
    shapes = shapes.withColumns({"r0": F.greatest(F.least(*rows), F.lit(0)), "r1": F.least(F.greatest(*rows), F.lit(grid.height - 1)), "c0": F.greatest(F.least(*cols), F.lit(0)), "c1": F.least(F.greatest(*cols), F.lit(grid.width - 1))})
    cells = (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1)
    some = (F.col("r1") >= F.col("r0")) & (F.col("c1") >= F.col("c0"))
    row_list = F.when(some & (cells > CELL_CAP), F.raise_error(F.lit(f"a feature covers more than {CELL_CAP} cells")).cast("array<int>")).when(some, F.sequence("r0", "r1")).otherwise(F.array().cast("array<int>"))
    tested = shapes.withColumn("row", F.explode(row_list)).withColumn("col", F.explode(F.sequence("c0", "c1")))
    centre = (G.centre_x(F.col("col"), grid.origin_x, grid.pixel_w), G.centre_y(F.col("row"), grid.origin_y, grid.pixel_h))
    inside = tested.filter((F.col("geom_type") == "polygon") & G.ray_cast(*centre, F.col("rings"))).select("feature_id", "row", "col")
    bare = shapes.join(inside.select("feature_id").distinct(), "feature_id", "left_anti")
    x, y = _centroid()
    fallback = bare.select("feature_id", x.alias("x"), y.alias("y")).select("feature_id", *cell(F.col("x"), F.col("y")))
    out = points.unionByName(inside).unionByName(fallback).filter(G.in_grid(F.col("row"), F.col("col"), grid.height, grid.width))
    return out.select("row", "col").distinct() if across else out.distinct()


def _axis(name: str):
    return lambda p: p[name]


def _times(name: str, weight):
    """The sum of an edge's two coordinates, weighted."""
    return lambda e: (e["p"][name] + e["q"][name]) * weight(e)


def _centroid():
    """Of the first ring: by area for a polygon, by length for a line; the mean of its vertices where that is zero."""
    ring = F.col("rings")[0]
    closed = F.when(F.col("geom_type") == "polygon", F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))).otherwise(F.slice(ring, 2, F.size(ring)))
    start = F.when(F.col("geom_type") == "polygon", ring).otherwise(F.slice(ring, 1, F.size(ring) - 1))
    pairs = F.zip_with(start, closed, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    length = lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])
    total = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, v: s + v)
    out = []
    for c in ("x", "y"):
        mean = F.aggregate(F.transform(ring, _axis(c)), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
        area = F.try_divide(total(_times(c, cross)), 3 * total(cross))
        line = F.try_divide(total(_times(c, length)), 2 * total(length))
        out.append(F.coalesce(F.when(F.col("geom_type") == "polygon", area).otherwise(line), mean))
    return out


def gather(pixels: DataFrame, places: DataFrame, grid: G.Grid | None = None, order: str = "ordinal") -> DataFrame:
    """The vectors at places (ordinal, row, col), in order; a place outside the grid is an error."""
    asked = places
    if grid is not None:
        bad = ~G.in_grid(F.col("row"), F.col("col"), grid.height, grid.width)
        asked = places.withColumn("row", F.when(bad, F.raise_error(F.lit("a place lies outside the grid")).cast("int")).otherwise(F.col("row")))
    return asked.join(pixels.select("row", "col", "embedding"), ["row", "col"]).orderBy(order)


def training_rows(pixels: DataFrame, features: DataFrame, grid: G.Grid, label: str) -> tuple[DataFrame, int]:
    """sample pixels with their feature's label, valid ones only; and how many features gave any."""
    places = feature_pixels(features, grid).join(features.select("feature_id", F.col(label).alias("label")), "feature_id")
    rows = places.join(pixels.select("row", "col", "embedding"), ["row", "col"]).filter(V.valid("embedding", grid.nodata))
    return rows, rows.select("feature_id").distinct().count()


def unique_names(wanted: Sequence[str], taken: Sequence[str] = ()) -> list[str]:
    """Names that differ whatever their case: later ones get _2, _3 and so on."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        free, n = name, 2
        while free.lower() in used:
            free, n = f"{name}_{n}", n + 1
        used.add(free.lower())
        out.append(free)
    return out


def extract(pixels: DataFrame, features: DataFrame, grid: G.Grid, skip_nodata: bool = True, bands: int | None = None) -> DataFrame:
    """One row a feature and pixel: the feature's attributes, the pixel's centre and place, and a column a band."""
    bands = bands or grid.bands
    attributes = [c for c in features.columns if c not in {"rings", "geom_type"}]
    joined = feature_pixels(features, grid).join(pixels.select("row", "col", "embedding"), ["row", "col"]).join(features.select(*attributes), "feature_id")
    if skip_nodata:
        joined = joined.filter(V.valid("embedding", grid.nodata))
    names = unique_names(["pixel_x", "pixel_y", "pixel_row", "pixel_col", *(f"A{b:02d}" for b in range(bands))], attributes)
    values = [G.centre_x(F.col("col"), grid.origin_x, grid.pixel_w), G.centre_y(F.col("row"), grid.origin_y, grid.pixel_h), F.col("row"), F.col("col"), *(F.get("embedding", F.lit(b)).cast("double") for b in range(bands))]
    return joined.select(*attributes, *(v.alias(n) for v, n in zip(values, names)))


def scatter_to_grid(grid_cells: DataFrame, values: DataFrame, column: str, fill: float | int | None, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Every cell of the grid with its value, `fill` where there is none."""
    out = grid_cells.select(*keys).join(values.select(*keys, column), list(keys), "left")
    return out if fill is None else out.withColumn(column, F.coalesce(F.col(column), F.lit(fill)))


def cells(spark, grid: G.Grid) -> DataFrame:
    """row and col of every cell."""
    n = grid.width * grid.height
    return spark.range(n).select((F.col("id") / grid.width).cast("int").alias("row"), (F.col("id") % grid.width).cast("int").alias("col"))
