"""Grid and bounding-box arithmetic as column functions, and grid planning on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 2017, 2025
BANDS = 64
RESOLUTION = 10.0
TARGET_CRS = "EPSG:3577"
LARGE_BYTES = 2 * 1024**3
ALIGN_TOLERANCE = 1e-6

_TILE = r"(?i)-(\d+)-(\d+)\.tiff?$"


@dataclass(frozen=True)
class Grid:
    """Size and affine transform of a grid; rows run down where pixel_h is negative."""

    grid_id: str
    crs: str
    width: int
    height: int
    origin_x: float
    pixel_w: float
    row_rot: float
    origin_y: float
    col_rot: float
    pixel_h: float
    nodata: float | None = None
    bands: int = BANDS

    @property
    def transform(self) -> tuple[float, ...]:
        return (self.origin_x, self.pixel_w, self.row_rot, self.origin_y, self.col_rot, self.pixel_h)

    def aligned_with(self, other: Grid) -> bool:
        """Same size and, within a small tolerance, the same transform."""
        return (self.width, self.height) == (other.width, other.height) and all(abs(a - b) <= ALIGN_TOLERANCE for a, b in zip(self.transform, other.transform))

    def pixel_area(self) -> float | None:
        """Square metres of a pixel; none for geographic coordinates or a degenerate transform."""
        if self.crs.upper() in {"EPSG:4326", "OGC:CRS84"} or self.crs.upper().startswith("GEOG"):
            return None
        return abs(self.pixel_w * self.pixel_h - self.row_rot * self.col_rot) or None


def plan_grid(bounds: tuple[float, float, float, float], resolution: float) -> tuple[int, int, tuple[float, float, float, float]]:
    """Columns, rows and snapped bounds: anchored top left, grown right and down to whole pixels, at least one each way."""
    left, bottom, right, top = map(float, bounds)
    if not all(map(math.isfinite, (left, bottom, right, top, resolution))) or resolution <= 0:
        raise ValueError("bounds must be finite and the resolution positive")
    if right <= left or top <= bottom:
        raise ValueError("bounds must have a positive width and height")
    wide, high = max(1, math.ceil((right - left) / resolution)), max(1, math.ceil((top - bottom) / resolution))
    return wide, high, (left, top - high * resolution, left + wide * resolution, top)


def grid_for(grid_id: str, bounds: tuple[float, float, float, float], resolution: float = RESOLUTION, crs: str = TARGET_CRS, nodata: float | None = None, bands: int = BANDS) -> Grid:
    wide, high, (left, _, _, top) = plan_grid(bounds, resolution)
    return Grid(grid_id, crs, wide, high, left, resolution, 0.0, top, 0.0, -resolution, nodata, bands)


def output_bytes(width: int, height: int, bands: int = BANDS) -> int:
    return width * height * bands * 4


def is_large(width: int, height: int) -> bool:
    """Worth a warning before it is fetched; never a reason to refuse."""
    return output_bytes(width, height) >= LARGE_BYTES


def is_supported_year(year: int) -> bool:
    return FIRST_YEAR <= year <= LAST_YEAR


def years_from_indices(indices: list[int]) -> list[int]:
    """Distinct years in order from indices into the supported range."""
    years = sorted({FIRST_YEAR + int(i) for i in indices})
    if any(not is_supported_year(y) for y in years):
        raise ValueError(f"years run from {FIRST_YEAR} to {LAST_YEAR}")
    return years


def column_of(x: Column, origin_x: Column | float, pixel_w: Column | float) -> Column:
    """Column index, cut towards zero: up to one pixel left of the grid is still column 0."""
    return ((x - origin_x) / pixel_w).cast("int")


def row_of(y: Column, origin_y: Column | float, pixel_h: Column | float) -> Column:
    return ((y - origin_y) / pixel_h).cast("int")


def centre_x(col: Column, origin_x: Column | float, pixel_w: Column | float) -> Column:
    return F.lit(origin_x) + (col + F.lit(0.5)) * F.lit(pixel_w)


def centre_y(row: Column, origin_y: Column | float, pixel_h: Column | float) -> Column:
    return F.lit(origin_y) + (row + F.lit(0.5)) * F.lit(pixel_h)


def in_grid(row: Column, col: Column, height: int, width: int) -> Column:
    return (row >= 0) & (row < height) & (col >= 0) & (col < width)


def boxes_overlap(a: tuple[Column, Column, Column, Column], b: tuple) -> Column:
    """(min_x, min_y, max_x, max_y) with a common area; touching edges do not count."""
    b = tuple(x if isinstance(x, Column) else F.lit(float(x)) for x in b)
    return (a[2] > b[0]) & (a[0] < b[2]) & (a[3] > b[1]) & (a[1] < b[3])


def utm_zone(lon: Column) -> Column:
    """UTM zone number by longitude alone, held within 1..60."""
    return F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180.0) / 6.0) + 1).cast("int")))


def utm_zones_of_box(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Names ("56S") of the zones whose strip a box overlaps, by hemisphere; reversed limits are swapped."""
    lo, hi = F.least(min_lon, max_lon), F.greatest(min_lon, max_lon)
    south, north = F.least(min_lat, max_lat) < 0, F.greatest(min_lat, max_lat) >= 0
    halves = F.filter(F.array(F.when(south, F.lit("S")), F.when(north, F.lit("N"))), lambda h: h.isNotNull())
    near = F.sequence(utm_zone(lo), utm_zone(hi))
    touched = F.filter(near, lambda z: (hi > z * 6 - 186) & (lo < z * 6 - 180))
    return F.flatten(F.transform(touched, lambda z: F.transform(halves, lambda h: F.concat(z.cast("string"), h))))


def tile_offsets(name: Column) -> tuple[Column, Column]:
    """The two offsets at the end of a tile's name, or NULL."""
    has = name.rlike(_TILE)
    return F.when(has, F.regexp_extract(name, _TILE, 1).cast("int")), F.when(has, F.regexp_extract(name, _TILE, 2).cast("int"))


def scene_key(name: Column) -> Column:
    """A tile's name without its offsets; any other name is its own key."""
    return F.regexp_replace(name, r"(?i)-\d+-\d+\.tiff?$", "")


def is_remote(path: Column) -> Column:
    """True for web addresses and virtual network paths."""
    return F.coalesce(F.lower(path).rlike(r"^https?://|/vsi(curl|s3|gs|az|adls|swift)(_streaming)?/"), F.lit(False))


def ray_cast(x: Column, y: Column, rings: Column) -> Column:
    """True where a point lies inside rings (array<array<struct<x,y>>>) by the even-odd rule."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        hit = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
        return F.size(F.filter(edges, hit))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, n: s + n) % 2 == 1


_A, _F = 6378137.0, 1 / 298.257223563
_GRS = 1 / 298.257222101
_N = _F / (2 - _F)


_K0 = 0.9996
_BIG_A = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def to_utm(lon: Column, lat: Column, zone: int | Column, south: bool | Column) -> tuple[Column, Column]:
    """WGS 84 degrees to UTM metres, by the Krüger series to the third order (well under a millimetre within a zone)."""
    alpha = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6 - 183.0))
    k = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + _K0 * _BIG_A * east, F.when(F.lit(south), 1e7).otherwise(0.0) + _K0 * _BIG_A * north


def from_utm(x: Column, y: Column, zone: int | Column, south: bool | Column) -> tuple[Column, Column]:
    """UTM metres to WGS 84 degrees, the inverse series."""
    beta = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
    delta = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
    xi, eta = (y - F.when(F.lit(south), 1e7).otherwise(0.0)) / (_K0 * _BIG_A), (x - 500000.0) / (_K0 * _BIG_A)
    up, across = xi, eta
    for j, b in enumerate(beta, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        across = across - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(across))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.lit(zone * 6 - 183.0) + F.degrees(F.atan2(F.sinh(across), F.cos(up))), F.degrees(phi)


def _albers_constants() -> tuple[float, float, float, float]:
    """n, C, rho0 and e of the Australian Albers projection (parallels -18 and -36, origin 132 E 0 N, GRS 80)."""
    e = math.sqrt(2 * _GRS - _GRS**2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e * e * math.sin(phi) ** 2)

    p1, p2 = math.radians(-18), math.radians(-36)
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return n, c, _A * math.sqrt(c - n * q(0.0)) / n, e


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to EPSG:3577 metres."""
    n, c, rho0, e = _albers_constants()
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = _A * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - F.lit(132.0))
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def from_albers(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3577 metres to degrees, by the series for the authalic latitude (well under a millimetre)."""
    n, c, rho0, e = _albers_constants()
    e2 = e * e
    # n is negative here, as both parallels are southern
    sign = math.copysign(1.0, n)
    rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    lon = 132.0 + F.degrees(F.atan2(sign * x, sign * (rho0 - y)) / n)
    q = (c - F.pow(rho * (n / _A), F.lit(2.0))) / n
    qp = 1 - (1 - e2) / (2 * e) * math.log((1 - e) / (1 + e))
    beta = F.asin(q / qp)
    m = _GRS / (2 - _GRS)
    phi = beta + (4 * m / 3 + 4 * m**2 / 45 - 16 * m**3 / 35) * F.sin(2 * beta) + (46 * m**2 / 45 + 152 * m**3 / 945) * F.sin(4 * beta) + 3044 * m**3 / 2835 * F.sin(6 * beta)
    return lon, F.degrees(phi)


def _code(crs: str) -> str:
    code = crs.upper().removeprefix("EPSG:")
    if code in {"4326", "3577"} or (len(code) == 5 and code[:3] in {"326", "327"} and 1 <= int(code[3:]) <= 60):
        return code
    raise ValueError(f"no projection to {crs}")


def _by_crs(crs: str | Column, geographic: tuple, albers, utm) -> tuple[Column, Column]:
    """The pair for a system that is named, or that a column names (NULL for one that is not known)."""
    if isinstance(crs, str):
        code = _code(crs)
        return geographic if code == "4326" else albers() if code == "3577" else utm(int(code[3:]), code[:3] == "327")
    code = F.regexp_replace(F.upper(crs), "^EPSG:", "")
    zoned = utm(F.substring(code, 4, 2).try_cast("int"), code.startswith("327"))
    return tuple(F.when(code == "4326", g).when(code == "3577", a).when(code.rlike("^32[67](0[1-9]|[1-5][0-9]|60)$"), u) for g, a, u in zip(geographic, albers(), zoned))


def project(lon: Column, lat: Column, crs: str | Column) -> tuple[Column, Column]:
    """Degrees to a supported coordinate system: EPSG:4326, 3577, 326zz or 327zz."""
    return _by_crs(crs, (lon, lat), lambda: to_albers(lon, lat), lambda zone, south: to_utm(lon, lat, zone, south))


def unproject(x: Column, y: Column, crs: str | Column) -> tuple[Column, Column]:
    """A supported coordinate system to degrees."""
    return _by_crs(crs, (x, y), lambda: from_albers(x, y), lambda zone, south: from_utm(x, y, zone, south))


def reproject(x: Column, y: Column, source: str | Column, target: str | Column) -> tuple[Column, Column]:
    """One system to another; what is in the same one already stays exactly as it is."""
    if isinstance(source, str) and isinstance(target, str) and source.upper() == target.upper():
        return x, y
    moved = project(*unproject(x, y, source), target)
    if isinstance(source, str) and isinstance(target, str):
        return moved
    same = F.upper(F.lit(source)) == F.upper(F.lit(target))
    return F.when(same, x).otherwise(moved[0]), F.when(same, y).otherwise(moved[1])


#: points a side by which a box is carried to another system; its sides become curves there
EDGE_POINTS = 8


def box_in(origin_x: Column, origin_y: Column, pixel_w: Column, pixel_h: Column, width: Column, height: Column, source: str | Column, target: str | Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of a raster in another system, from points along its sides."""
    steps = F.sequence(F.lit(0), F.lit(EDGE_POINTS))
    along = lambda origin, size, n: F.transform(steps, lambda i: origin + size * n * i / F.lit(float(EDGE_POINTS)))
    xs, ys = along(origin_x, pixel_w, width), along(origin_y, pixel_h, height)
    right, bottom = origin_x + pixel_w * width, origin_y + pixel_h * height
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    sides = F.concat(F.transform(xs, lambda x: at(x, F.lit(origin_y))), F.transform(xs, lambda x: at(x, bottom)), F.transform(ys, lambda y: at(F.lit(origin_x), y)), F.transform(ys, lambda y: at(right, y)))

    def degrees(p: Column) -> Column:
        lon, lat = unproject(p["x"], p["y"], source)
        return F.struct(lon.alias("lon"), lat.alias("lat"), p.alias("p"))

    def moved(d: Column) -> Column:
        x, y = project(d["lon"], d["lat"], target)
        same = F.upper(F.lit(source)) == F.upper(F.lit(target))
        return F.struct(F.when(same, d["p"]["x"]).otherwise(x).alias("x"), F.when(same, d["p"]["y"]).otherwise(y).alias("y"))

    same_system = isinstance(source, str) and isinstance(target, str) and source.upper() == target.upper()
    points = sides if same_system else F.transform(F.transform(sides, degrees), moved)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that come out of a generator of one row: later filters and projections take them instead of repeating their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_reprojected(df: DataFrame, x: Column, y: Column, source: str | Column, target: str | Column) -> DataFrame:
    """df with columns _x and _y: reproject() in steps, so that each intermediate value is computed once."""
    if isinstance(source, str) and isinstance(target, str) and source.upper() == target.upper():
        return df.withColumns({"_x": x, "_y": y})
    df = held(df, _x0=x, _y0=y)
    lon, lat = unproject(F.col("_x0"), F.col("_y0"), source)
    df = held(df, _lon=lon, _lat=lat)
    mx, my = project(F.col("_lon"), F.col("_lat"), target)
    same = F.upper(F.lit(source)) == F.upper(F.lit(target))
    return held(df, _x=F.when(same, F.col("_x0")).otherwise(mx), _y=F.when(same, F.col("_y0")).otherwise(my)).drop("_x0", "_y0", "_lon", "_lat")


def or_default(crs: str | None, default: str = TARGET_CRS) -> str:
    """A coordinate system that can be projected to, or the default."""
    try:
        return f"EPSG:{_code(crs or '')}"
    except ValueError:
        return default
