"""Finding, culling, mosaicking and reading the tiles of a large archive of signed-byte embeddings."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.functions import geometry as G
from gridlore.functions import vectors as V

CACHE_VERSION = 1
PAGE_SIZE = 1000
HTTP_TIMEOUT = 60
_LISTING = "items array<struct<name:string>>, nextPageToken string"


# ------------------------------------------------------------------ listings


def normalise_bucket(bucket: str) -> str:
    """A bucket's bare name, from gs://, a virtual path or an address."""
    for lead in ("gs://", "/vsigs/", "https://storage.googleapis.com/"):
        if bucket.lower().startswith(lead):
            bucket = bucket[len(lead) :]
    return bucket.strip("/")


def zone_prefix(prefix: str, year: int, zone: str) -> str:
    return f"{prefix.strip('/')}/{year}/{zone}/"


def object_url(bucket: str, name: str) -> str:
    return f"https://storage.googleapis.com/{normalise_bucket(bucket)}/{name.lstrip('/')}"


def virtual_path(url: str) -> str:
    return url if url.lower().startswith("/vsi") else f"/vsicurl/{url}"


def parse_listing(documents: DataFrame, column: str = "value") -> DataFrame:
    """Names of the .tif and .tiff objects in listing documents (JSON text)."""
    parsed = documents.select(F.from_json(column, _LISTING).alias("d"))
    return parsed.select(F.explode("d.items").alias("i")).select(F.col("i.name").alias("name")).filter(F.lower("name").rlike(r"\.tiff?$"))


def fetch_json(url: str) -> dict[str, Any]:
    from urllib.request import urlopen

    with urlopen(url, timeout=HTTP_TIMEOUT) as answer:  # noqa: S310 - an address the caller gave
        return json.load(answer)


def list_tiles(spark: SparkSession, year: int, zone: str, bucket: str, prefix: str, fetch: Callable[[str], dict[str, Any]] = fetch_json) -> DataFrame:
    """year, zone and name of a zone's tiles, in order of name; follows the pages of the listing.

    One zone has some thousands of names and pages follow one another, so the
    driver reads them.
    """
    if not G.is_supported_year(year):
        raise ValueError(f"years run from {G.FIRST_YEAR} to {G.LAST_YEAR}")
    pages, token = [], None
    while True:
        query = {"prefix": zone_prefix(prefix, year, zone), "maxResults": PAGE_SIZE, "fields": "items(name),nextPageToken"} | ({"pageToken": token} if token else {})
        document = fetch(f"https://storage.googleapis.com/storage/v1/b/{normalise_bucket(bucket)}/o?{urlencode(query)}")
        pages.append((json.dumps(document),))
        token = document.get("nextPageToken")
        if not token:
            break
    names = parse_listing(spark.createDataFrame(pages, "value string"))
    return names.select(F.lit(year).alias("year"), F.lit(zone).alias("zone"), "name").orderBy("name")


# ------------------------------------------------------------------ caches


@dataclass(frozen=True)
class Cache:
    """A Parquet table of what has been read about tiles, kept by (year, zone), one for each kind, bucket and prefix."""

    root: str
    bucket: str
    prefix: str

    def _path(self, kind: str) -> str:
        return f"{self.root.rstrip('/')}/{kind}-v{CACHE_VERSION}/bucket={normalise_bucket(self.bucket)}/prefix={self.prefix.strip('/').replace('/', '_')}"

    def save(self, table: DataFrame, kind: str = "footprints") -> bool:
        """Replace the (year, zone) parts that the table has. A cache never ends a run: False if it could not be written."""
        try:
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "zone").parquet(self._path(kind))
        except Exception:  # noqa: BLE001 - by design
            return False
        return True

    def load(self, spark: SparkSession, year: int, zone: str, schema: str, kind: str = "footprints") -> DataFrame:
        """The kept rows of a year and zone, whole ones only; none for another bucket, prefix or version."""
        try:
            rows = spark.read.schema(f"{schema}, year int, zone string").parquet(self._path(kind))
            rows = rows.filter((F.col("year") == year) & (F.col("zone") == zone))
            return rows.na.drop()
        except Exception:  # noqa: BLE001 - nothing kept
            return spark.createDataFrame([], f"{schema}, year int, zone string")


FOOTPRINTS = "name string, min_lon double, min_lat double, max_lon double, max_lat double"
ANCHORS = "scene_key string, name string, min_lon double, min_lat double, max_lon double, max_lat double, x_pixels int, y_pixels int, offset_a int, offset_b int"


def split_by_cache(names: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names that the cache has, and those it has not."""
    return names.join(kept.select("name"), "name", "left_semi"), names.join(kept.select("name"), "name", "left_anti")


# ------------------------------------------------------------------ culling


def with_scene(tiles: DataFrame) -> DataFrame:
    """scene_key, offset_a and offset_b from the name."""
    a, b = G.tile_offsets(F.col("name"))
    return tiles.withColumns({"scene_key": G.scene_key(F.col("name")), "offset_a": a, "offset_b": b})


def scene_groups(tiles: DataFrame) -> DataFrame:
    return with_scene(tiles).groupBy("scene_key").agg(F.count("*").alias("n_tiles"), F.sort_array(F.collect_list("name")).alias("names"))


def scene_bounds(tiles: DataFrame, anchors: DataFrame, margin: float = 0.5) -> DataFrame:
    """scene_key and a box that surely holds the scene, from one read tile and all tiles' offsets.

    The box is the anchor's, wider on all sides by the farthest offset and a
    tile, at the larger of its degrees a pixel, and half as much again.  Without
    offsets, or an anchor without pixels, it is the anchor's.
    """
    reach = F.max(F.greatest(F.abs(F.col("offset_a") - F.col("a0")), F.abs(F.col("offset_b") - F.col("b0"))))
    named = anchors.withColumnsRenamed({"offset_a": "a0", "offset_b": "b0"}).drop("name", "year", "zone")
    joined = with_scene(tiles).select("scene_key", "offset_a", "offset_b").join(named, "scene_key")
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    got = joined.groupBy("scene_key", *box, "x_pixels", "y_pixels").agg(reach.alias("reach"))
    per = F.greatest((F.col("max_lon") - F.col("min_lon")) / F.col("x_pixels"), (F.col("max_lat") - F.col("min_lat")) / F.col("y_pixels"))
    usable = (F.col("x_pixels") > 0) & (F.col("y_pixels") > 0) & F.col("reach").isNotNull()
    pad = F.when(usable, per * (F.col("reach") + F.greatest("x_pixels", "y_pixels")) * F.lit(1 + margin)).otherwise(0.0)
    return got.select("scene_key", *((F.col(c) + (pad if c.startswith("max") else -pad)).alias(c) for c in box))


def cull(tiles: DataFrame, anchors: DataFrame, aoi: Sequence[float]) -> DataFrame:
    """The tiles of scenes whose box meets the area; a scene without an anchor stays."""
    boxes = scene_bounds(tiles, anchors)
    meets = G.boxes_overlap(tuple(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")), tuple(aoi))
    kept = with_scene(tiles).join(boxes, "scene_key", "left").filter(F.col("min_lon").isNull() | meets)
    return kept.select(*tiles.columns)


def tiles_meeting(footprints: DataFrame, aoi: Sequence[float]) -> DataFrame:
    """The tiles whose footprint meets the area, in order of name: a filter with constants, which reaches the scan."""
    box = tuple(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    return footprints.filter(G.boxes_overlap(box, tuple(aoi))).orderBy("name")


def zones_of_area(spark: SparkSession, aoi: Sequence[float]) -> list[str]:
    row = spark.createDataFrame([tuple(map(float, aoi))], "a double, b double, c double, d double")
    zones = row.select(G.utm_zones_of_box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("z")).first()["z"]
    if not zones:
        raise ValueError("the area touches no zone")
    return zones


# ------------------------------------------------------------------ rasters


def warp_nearest(pixels: DataFrame, source: G.Grid, target: G.Grid) -> DataFrame:
    """The source's pixels on the target's grid, nearest neighbour; cells outside the source have none.

    Each target cell's centre is carried to the source's coordinate system, as
    column arithmetic, then one equi-join on the source's row and column; a source
    pixel may serve many cells.
    """
    from gridlore.operators.sampling import cells

    x, y = G.centre_x(F.col("col"), target.origin_x, target.pixel_w), G.centre_y(F.col("row"), target.origin_y, target.pixel_h)
    placed = G.with_reprojected(cells(pixels.sparkSession, target), x, y, target.crs, source.crs)
    asked = placed.select("row", "col", F.floor((F.col("_y") - source.origin_y) / source.pixel_h).cast("int").alias("_row"), F.floor((F.col("_x") - source.origin_x) / source.pixel_w).cast("int").alias("_col"))
    inside = asked.filter(G.in_grid(F.col("_row"), F.col("_col"), source.height, source.width))
    held = pixels.withColumnsRenamed({"row": "_row", "col": "_col"})
    return inside.join(held, ["_row", "_col"]).drop("_row", "_col").withColumn("grid_id", F.lit(target.grid_id))


def mosaic(tiles: Sequence[tuple[str, DataFrame, G.Grid]], target: G.Grid, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Many tiles on one grid; where they overlap, a valid pixel of the tile last in order of name wins."""
    if not tiles:
        raise ValueError("no tiles")
    warped = [warp_nearest(df, grid, target).withColumn("_tile", F.lit(name)) for name, df, grid in tiles]
    every = warped[0]
    for more in warped[1:]:
        every = every.unionByName(more)
    return resolve_overlap(every, keys)


def resolve_overlap(pixels: DataFrame, keys: Sequence[str] = ("row", "col"), tile: str = "_tile") -> DataFrame:
    """One row a cell: that of the greatest tile name, valid ones first; an aggregation, so it is reduced before the shuffle."""
    rest = [c for c in pixels.columns if c not in {*keys, tile}]
    ok = F.exists("embedding", lambda x: x != V.FILL_BYTE) if dict(pixels.dtypes)["embedding"] == "array<tinyint>" else V.valid("embedding", V.FILL)
    return pixels.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ok, F.col(tile))).alias("_s")).select(*keys, "_s.*")


def grid_of_area(grid_id: str, aoi: Sequence[float], crs: str, resolution: float, spark: SparkSession) -> G.Grid:
    """A grid over an area in degrees: its corners projected, their box snapped."""
    a, b, c, d = map(float, aoi)
    rows = spark.createDataFrame([(a, b), (a, d), (c, b), (c, d)], "lon double, lat double").select(*(e.alias(n) for e, n in zip(G.project(F.col("lon"), F.col("lat"), crs), "xy"))).collect()
    xs, ys = [r["x"] for r in rows], [r["y"] for r in rows]
    return G.grid_for(grid_id, (min(xs), min(ys), max(xs), max(ys)), resolution, crs, V.FILL)


def _with_size(archive: DataFrame, tiles: DataFrame) -> DataFrame:
    """The tiles with width and height: their own, or as far as the archive has pixels of them."""
    if {"width", "height"} <= set(tiles.columns):
        return tiles
    sizes = archive.groupBy("tile").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    return tiles.drop("width", "height").join(sizes, "tile")


def cells_of_tiles(tiles: DataFrame, target: G.Grid) -> DataFrame:
    """row and col of every target cell whose centre lies in a tile, with the tile and its _row and _col there.

    tiles: tile, origin_x, origin_y, pixel_w, pixel_h, width, height and, if it
    is not the target's, crs.  A tile's box in the target's system, a little wider, names the cells to try, so
    no cell is compared with tiles that are not near; cells are made by tile and
    row, spread over all partitions.
    """
    col = F.col
    crs = col("crs") if "crs" in tiles.columns else target.crs
    box = G.box_in(col("origin_x"), col("origin_y"), col("pixel_w"), col("pixel_h"), col("width"), col("height"), crs, target.crs)
    boxed = G.held(tiles, box=box)
    spare = lambda low, high, size: F.lit(2 * abs(size)) + (col(f"box.{high}") - col(f"box.{low}")) * 0.002  # noqa: E731 - what the sides bulge between points
    wide, high = spare("min_x", "max_x", target.pixel_w), spare("min_y", "max_y", target.pixel_h)
    ends = lambda a, b, origin, size: ((a - F.lit(origin)) / F.lit(size), (b - F.lit(origin)) / F.lit(size))
    c = ends(col("box.min_x") - wide, col("box.max_x") + wide, target.origin_x, target.pixel_w)
    r = ends(col("box.min_y") - high, col("box.max_y") + high, target.origin_y, target.pixel_h)
    near = boxed.withColumns({
        "r0": F.greatest(F.lit(0), F.floor(F.least(*r)).cast("int")), "r1": F.least(F.lit(target.height - 1), F.floor(F.greatest(*r)).cast("int")),
        "c0": F.greatest(F.lit(0), F.floor(F.least(*c)).cast("int")), "c1": F.least(F.lit(target.width - 1), F.floor(F.greatest(*c)).cast("int")),
    }).filter("r0 <= r1 AND c0 <= c1").drop("box")
    rows = near.withColumn("row", F.explode(F.sequence("r0", "r1")))
    rows = rows.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile", "row")
    every = rows.withColumn("col", F.explode(F.sequence("c0", "c1")))
    moved = G.with_reprojected(every, G.centre_x(col("col"), target.origin_x, target.pixel_w), G.centre_y(col("row"), target.origin_y, target.pixel_h), target.crs, crs)
    placed = moved.select("tile", "row", "col", "width", "height", F.floor((col("_y") - col("origin_y")) / col("pixel_h")).cast("int").alias("_row"), F.floor((col("_x") - col("origin_x")) / col("pixel_w")).cast("int").alias("_col"))
    return placed.filter((col("_row") >= 0) & (col("_row") < col("height")) & (col("_col") >= 0) & (col("_col") < col("width"))).select("tile", "row", "col", "_row", "_col")


def load_year(archive: DataFrame, year: int, target: G.Grid, tile_grids: DataFrame, aoi: Sequence[float] | None = None) -> DataFrame:
    """One year's floats on the target's grid from an archive of signed bytes, nearest neighbour.

    archive: tile (its name), year, row, col and embedding (array<tinyint>),
    partitioned by year; tile_grids: tile, year, footprint, origin_x, origin_y,
    pixel_w and pixel_h, and where known width, height and crs (the target's where
    there is none).  Each target cell's centre is carried to the system of the
    tiles around it, so finer and coarser grids are filled alike and tiles of
    several zones meet on one grid; one equi-join fetches the pixels.
    """
    if not G.is_supported_year(year):
        raise ValueError(f"years run from {G.FIRST_YEAR} to {G.LAST_YEAR}")
    chosen = tile_grids.filter(F.col("year") == year)
    if aoi is not None:
        chosen = chosen.filter(G.boxes_overlap(tuple(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")), tuple(aoi)))
    held = archive.filter(F.col("year") == year)
    crs = [F.coalesce(F.col("crs"), F.lit(target.crs)).alias("crs")] if "crs" in chosen.columns else []
    size = [c for c in ("width", "height") if c in chosen.columns]
    tiles = _with_size(held, chosen.select("tile", "origin_x", "origin_y", "pixel_w", "pixel_h", *size, *crs))
    wanted = cells_of_tiles(tiles, target)
    got = wanted.join(held.select("tile", F.col("row").alias("_row"), F.col("col").alias("_col"), "embedding"), ["tile", "_row", "_col"])
    one = resolve_overlap(got.select("row", "col", F.col("tile").alias("_tile"), "embedding"))
    return one.select(F.lit(target.grid_id).alias("grid_id"), F.lit(year).alias("year"), "row", "col", V.dequantise("embedding").alias("embedding"))


def load_years(archive: DataFrame, years: Sequence[int], target: G.Grid, tile_grids: DataFrame, aoi: Sequence[float] | None = None) -> DataFrame:
    """Several years on one grid, as one plan; write it with partitionBy('year') for one folder a year."""
    if not years:
        raise ValueError("one year or more")
    out = None
    for year in sorted(set(years)):
        part = load_year(archive, year, target, tile_grids, aoi)
        out = part if out is None else out.unionByName(part)
    return out


def load_embedding(spark: SparkSession, layer: DataFrame | str | None = None, url: str | None = None, year: int = 0, archive: DataFrame | None = None, target: G.Grid | None = None, tile_grids: DataFrame | None = None, aoi: Sequence[float] | None = None) -> DataFrame:
    """Pixels from a table or path, else an address, else a year of the archive; what is given explicitly is taken as it is."""
    if layer is not None:
        return layer if isinstance(layer, DataFrame) else spark.read.parquet(layer)
    if url:
        return spark.read.parquet(url)
    if year:
        if archive is None or target is None or tile_grids is None:
            raise ValueError("a year needs the archive, its tile grids and a target grid")
        return load_year(archive, year, target, tile_grids, aoi)
    raise ValueError("a layer, an address or a year is needed")


def change_years(archive: DataFrame, years: Sequence[int], target: G.Grid, tile_grids: DataFrame, metric: str = "cosine", mode: str = "pairwise", aoi: Sequence[float] | None = None, save: str | None = None, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """The change map of two years or more of the archive (complete: of the pixels that have all of them), and the pixels behind it (saved by year if asked for)."""
    from gridlore.operators.change import change

    if len(set(years)) < 2:
        raise ValueError("two years or more are needed")
    pixels = load_years(archive, years, target, tile_grids, aoi)
    if save:
        pixels.write.mode("overwrite").partitionBy("year").parquet(save)
        pixels = pixels.sparkSession.read.parquet(save)
    return change(pixels, metric, mode, list(years), target.nodata, complete=complete), pixels


def first_tile(names: DataFrame) -> DataFrame:
    """The anchor to read of each scene: its first name."""
    return with_scene(names).withColumn("_n", F.row_number().over(Window.partitionBy("scene_key").orderBy("name"))).filter("_n = 1").drop("_n")


# ------------------------------------------------------------------ the whole fetch


@dataclass
class Fetched:
    """What a fetch found: the pixels, lazily, and a report of what it did."""

    pixels: DataFrame
    tiles: DataFrame
    zones: list[str]
    listed: int
    headers_read: int
    unreadable: list[str]
    warnings: list[str]


HEADERS = "name string, crs string, width int, height int, origin_x double, origin_y double, pixel_w double, pixel_h double"
_TILES = f"{HEADERS}, min_lon double, min_lat double, max_lon double, max_lat double"


def with_footprints(headers: DataFrame) -> DataFrame:
    """min_lon, min_lat, max_lon and max_lat of each header; NULL where its system is not known or the header could not be read."""
    c = F.col
    box = G.box_in(c("origin_x"), c("origin_y"), c("pixel_w"), c("pixel_h"), c("width"), c("height"), c("crs"), "EPSG:4326")
    return G.held(headers, _box=box).select(*headers.columns, *(c(f"_box.{a}").alias(b) for a, b in (("min_x", "min_lon"), ("min_y", "min_lat"), ("max_x", "max_lon"), ("max_y", "max_lat"))))


def fetch_year(spark: SparkSession, year: int, aoi: Sequence[float], target: G.Grid, read_headers: Callable[[DataFrame], DataFrame], read_tiles: Callable[[DataFrame], DataFrame], bucket: str = "", prefix: str = "", fetch: Callable[[str], dict[str, Any]] = fetch_json, cache: Cache | None = None) -> Fetched:
    """A year of an area from the object store: zones, listing, anchors, cull, headers, footprints, mosaic.

    read_headers: names -> HEADERS (NULL for what cannot be read), run on executors;
    read_tiles: tiles -> tile, row, col, embedding (array<tinyint>).  A header is
    read once a scene first; only tiles of scenes that may meet the area, and that
    the cache has not, are read then.
    """
    zones = zones_of_area(spark, aoi)
    warnings = [f"{target.width} x {target.height} cells are {G.output_bytes(target.width, target.height) / 2**30:.1f} GiB uncompressed"] if G.is_large(target.width, target.height) else []
    found, listed, read, unreadable = [], 0, 0, []
    for zone in zones:  # a box touches few zones
        names = list_tiles(spark, year, zone, bucket, prefix, fetch).select("name").persist()
        listed += names.count()
        kept = cache.load(spark, year, zone, _TILES).drop("year", "zone") if cache else spark.createDataFrame([], _TILES)
        have, miss = split_by_cache(names, kept)
        seen = with_scene(kept).select("scene_key").distinct()
        anchors = with_footprints(read_headers(first_tile(with_scene(miss).join(seen, "scene_key", "left_anti").select("name")).select("name"))).persist()
        usable = with_scene(kept.unionByName(anchors.filter("min_lon IS NOT NULL")))
        one = usable.withColumn("_n", F.row_number().over(Window.partitionBy("scene_key").orderBy("name"))).filter("_n = 1")
        boxes = one.select("scene_key", "name", "min_lon", "min_lat", "max_lon", "max_lat", F.col("width").alias("x_pixels"), F.col("height").alias("y_pixels"), "offset_a", "offset_b")
        left = cull(miss, boxes, aoi).join(anchors.select("name"), "name", "left_anti")
        fresh = with_footprints(read_headers(left)).unionByName(anchors).persist()
        read += fresh.count()
        unreadable += [r["name"] for r in fresh.filter("min_lon IS NULL").select("name").collect()]
        good = fresh.filter("min_lon IS NOT NULL")
        if cache and not good.isEmpty():
            # the folder that is replaced is also read, so its rows (a few thousand a zone) go through the driver
            whole = spark.createDataFrame(kept.unionByName(good).toArrow(), _TILES)
            if not cache.save(whole.select("*", F.lit(year).alias("year"), F.lit(zone).alias("zone"))):
                warnings.append(f"what was read of zone {zone} could not be kept")
        found.append(spark.createDataFrame(kept.join(have, "name", "left_semi").unionByName(good).toArrow(), _TILES))
        for held in (names, anchors, fresh):
            held.unpersist()
    tiles = found[0]
    for more in found[1:]:
        tiles = tiles.unionByName(more)
    meeting = tiles_meeting(tiles, aoi).withColumnRenamed("name", "tile").withColumn("year", F.lit(year))
    if unreadable:
        warnings.append(f"{len(unreadable)} tiles could not be read and are left out")
    archive = read_tiles(meeting).withColumn("year", F.lit(year))
    return Fetched(load_year(archive, year, target, meeting), meeting, zones, listed, read, sorted(unreadable), warnings)
